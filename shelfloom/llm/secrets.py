"""Secret scans: fixed patterns, and password guess cost on the values that
stand in a credential context.

The guess cost of a value is the cheapest way to cut it into dictionary words
(forwards or backwards, with letters swapped for signs), dates, repeats,
keyboard walks and brute-force spans: a dynamic program over its characters, in
bits. A value whose cost reaches ``STRONG_BITS`` is a span of kind ``guess``;
spans of the base patterns stay whatever their cost.

The dictionary is what people put into passwords, then the words of public
tokenizers' vocabularies in their own order, which is about that of their frequency
in public text: so prose behind a context word costs little and is no secret. A
caller may give other vocabulary files, or none. A run of letters that is no word of
the dictionary but spelt like them (by its triples of letters) costs no more than a
guess among all compounds and inflected forms of a language, ``COMPOUND_BITS``. In
addresses, paths, calls and names made of words, each part is judged by itself, as
what joins them is no secret: such a value costs what its dearest part costs, and
which of them it is.

Defined results: null and empty texts have no spans; offsets count code
points, ends exclusive; equal spans of several contexts are one; texts and
values of any length are read whole; repeated rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, renamed

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the first 24 decide
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: Further credential contexts, whose values only the guess cost judges. A key word stands alone or as a part
#: of a longer name (``AWS_SECRET_ACCESS_KEY``, ``secretAccessKey``), and blanks of any kind may be around the sign.
_BEFORE = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
_AFTER = r"(?:(?![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
CONTEXT = re.compile(
    _BEFORE
    + r"(?:pwd|pass(?:word|wd|phrase|code)?|credentials?|auth(?:orization)?|bearer|private_?key|access_?key|secret|token|api_?key|login|pin)"
    + _AFTER
    + r"""[A-Za-z0-9_.-]{0,40}["']?(?:\s*[:=]\s*|\s+is\s+)(?:bearer\s+)?["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "api", "cred", "auth", "bearer", "key", "login", "pin")
STRONG_BITS = 40.0

# Words people put into passwords, commonest first.
WORDS = (
    "password passwd pass admin welcome login letmein monkey dragon master hello secret qwerty shadow football baseball "
    "superman batman princess sunshine iloveyou love trustno ninja flower summer winter spring autumn january february "
    "march april may june july august september october november december monday friday sunday test guest root user "
    "default changeme access server database system oracle example sample demo token key api value none null true false "
    "the and for you not with this that have from"
).split()
LEET = str.maketrans("@4831!05$7", "aabeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
SEGMENT_BITS = 1.0
COMPOUND_BITS = 30.0
#: Bits a letter, under the dictionary's triples of letters, up to which a run of letters is spelt like a word.
SPELT_BITS, SPELT_LEAST = 5.0, 6
LETTERS = re.compile(r"[^\W\d_]+")
#: Addresses of pages and people, paths, calls and references to variables.
SHAPE = re.compile(r"[A-Za-z][A-Za-z0-9+]*://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:~|\.{1,2}|[A-Za-z]:)?(?:[/\\][\w .@-]+)+[/\\]?|[A-Za-z_][\w.]*\([^()]*\)|[$%]\{?[\w.]+[}%]?")
_PART = re.compile(r"[A-Z]?[a-z\u00df-\u024f]+|[A-Z]+(?![a-z])|[^\W\d_]+|[^\s/\\:@?&=#.()\[\]{}$%~,;_-]+")
LEAST_WORD = 3


def _near_keys() -> set[str]:
    pairs = set()
    for row in ROWS:
        for a, b in zip(row, row[1:]):
            pairs |= {a + b, b + a}
    return pairs


NEAR = _near_keys()


def _alphabet_bits(value: str) -> float:
    size = 0
    size += 10 * any("0" <= c <= "9" for c in value)
    size += 26 * any("a" <= c <= "z" for c in value)
    size += 26 * any("A" <= c <= "Z" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value)
    size += 128 * any(not c.isascii() for c in value)
    if size == 36 and re.fullmatch(r"[0-9a-f]+", value):
        size = 16
    return math.log2(max(size, 2))


@dataclass(frozen=True)
class Words:
    """Ranks of dictionary words of ``LEAST_WORD`` letters or more."""

    rank: dict[str, int]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.rank), default=0)

    @cached_property
    def _triples(self) -> tuple[Counter, Counter]:
        triples, pairs = Counter(), Counter()
        for w in self.rank:
            w = f" {w} "
            triples.update(zip(w, w[1:], w[2:]))
            pairs.update(zip(w[:-2], w[1:]))
        return triples, pairs

    def spelt(self, run: str) -> bool:
        """Whether a run of letters is spelt like the words."""
        if len(run) < SPELT_LEAST or run[1:] != run[1:].lower() and run != run.upper():
            return False
        triples, pairs = self._triples
        w = f" {run.lower()} "
        bits = sum(-math.log2((triples[a, b, c] + 0.1) / (pairs[a, b] + 3.0)) for a, b, c in zip(w, w[1:], w[2:]))
        return bits <= SPELT_BITS * len(run)


def dictionary(vocabulary: list[str] = ()) -> Words:
    """The fixed words, then the others in the order given; each once."""
    rank: dict[str, int] = {}
    for w in [*WORDS, *vocabulary]:
        if len(w) >= LEAST_WORD:
            rank.setdefault(w.lower(), len(rank) + 1)
    return Words(rank)


def vocabulary_words(path: str) -> list[str]:
    """The whole words of letters in a byte-level vocabulary file, by their
    number; a word is a token that begins with a blank. A ``.tiktoken`` file holds
    bytes, any other those of Latin letters alone."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        found = (t.decode("utf-8", "replace") for _, t in ranked)
        return [t[1:] for t in found if t[:1] == " " and LETTERS.fullmatch(t, 1)]
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [t[1:] for t in sorted(vocab, key=vocab.get) if re.fullmatch("\u0120[A-Za-z]+", t)]


def _pieces(value: str, words: Words):
    """(start, end, bits) of every word, date, repeat and walk in the value."""
    low = value.lower()
    flat = low.translate(LEET)
    rank, longest = words.rank, words.longest
    for i in range(len(low)):
        for j in range(i + LEAST_WORD, min(len(low), i + longest) + 1):
            part = flat[i:j]
            forwards, backwards = rank.get(part), rank.get(part[::-1])
            if forwards or backwards:
                bits = min(math.log2(forwards + 1) if forwards else 99.0, math.log2(backwards + 1) + 1 if backwards else 99.0)
                yield i, j, bits + (low[i:j] != value[i:j]) * 2 + (part != low[i:j]) * 2
    for m in LETTERS.finditer(value):
        if words.spelt(m[0]):
            yield m.start(), m.end(), COMPOUND_BITS
    for m in DATE.finditer(value):
        yield m.start(), m.end(), math.log2(130) if m.end() - m.start() == 4 else math.log2(365 * 130)
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or value[i] != value[start]:
            if i - start >= 3:
                yield start, i, 6.0 + math.log2(i - start)
            start = i
    start = 0
    for i in range(1, len(low) + 1):
        if i == len(low) or low[i - 1 : i + 1] not in NEAR:
            if i - start >= 4:
                yield start, i, math.log2(2 * len(ROWS[0])) + math.log2(i - start) + 1
            start = i


def guess_bits(value: str, words: Words | None = None) -> float:
    """Base-2 logarithm of the guesses that the cheapest segmentation needs."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in _pieces(value, words or FIXED):
        ends.setdefault(j, []).append((i, bits))
    per_char = _alphabet_bits(value)
    best = [0.0]
    for j in range(1, len(value) + 1):
        cost = best[j - 1] + per_char
        for i, bits in ends.get(j, ()):
            cost = min(cost, best[i] + bits + SEGMENT_BITS)
        best.append(cost)
    return best[-1]


def value_bits(value: str, words: Words) -> float:
    """``guess_bits`` of a value, or of the dearest part of one that is an address, a path, a call or a name made of words."""
    value = value.rstrip(".!?)") if not value.endswith("()") else value
    parts = _PART.findall(value)
    named = len(parts) > 1 and all(p.lower() in words.rank or words.spelt(p) for p in parts)
    if not parts or not (named or SHAPE.fullmatch(value)):
        return guess_bits(value, words)
    return max(guess_bits(p, words) for p in parts) + math.log2(len(parts))


#: The fixed words alone.
FIXED = dictionary()


def scan(text: str | None, words: Words | None = None) -> list[tuple[int, str, int, float | None]]:
    """(start, kind, end, bits) of every span, by start, then kind as listed."""
    if not text:
        return []
    spans: list[tuple[int, str, int, float | None]] = []
    values: set[tuple[int, int]] = set()
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                spans.append((m.start(), "assign", m.end(), None))
                values.add(m.span(2))
        values.update(m.span(1) for m in CONTEXT.finditer(text))
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), "hex", m.end(), None) for m in HEX.finditer(text)]
    for a, b in values:
        bits = value_bits(text[a:b], words or FIXED)
        if bits >= STRONG_BITS:
            spans.append((a, "guess", b, bits))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bits", T.DoubleType())]
)


def interleaved(lists: Sequence[list[str]]) -> list[str]:
    """The words of several lists by their place in them."""
    return [w for row in zip_longest(*lists) for w in row if w is not None]


def with_spans(docs: DataFrame, *, text_col: str = "text", name: str = "spans", vocabularies: Sequence[str] = ()) -> DataFrame:
    """``docs`` with an array of (kind, start, end, bits); bits only of kind
    ``guess``. ``vocabularies`` are the paths of byte-level vocabulary files,
    read on the driver and shipped as ranks (some MB, fixed)."""
    words = interleaved([vocabulary_words(path) for path in vocabularies])
    shipped = docs.sparkSession.sparkContext.broadcast(dictionary(words))

    def factory():
        words = shipped.value
        return lambda text: ([{"kind": k, "start": a, "end": b, "bits": bits} for a, k, b, bits in scan(text, words)],)

    return add_columns(docs, [text_col], T.StructType([T.StructField(name, T.ArrayType(SPAN))]), factory)


def query(spark: SparkSession, documents: DataFrame, *vocabularies: str) -> DataFrame:
    rows = with_spans(renamed(documents, doc_id="doc_id", text="text"), vocabularies=vocabularies)
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
