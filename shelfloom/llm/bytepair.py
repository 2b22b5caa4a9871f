"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a piece are read as Latin-1 letters, so that an Aho-Corasick
automaton of all tokens finds every token at every place in one pass. Encoding
takes the longest token at each place that may follow the one before it; where
none may, it gives up the last token and tries that one's next shorter prefix.
Places that are known to lead nowhere are marked, so each is given up once, and
the work is linear in the piece. Two tokens may stand side by side if merging
their bytes by rank gives just these two; a sequence all of whose neighbours may
is what merging by rank gives. That is found once a pair and remembered.

Reads a rank file: a token in base 64 and its number on every line. A piece that
is a token as a whole is that token, as in the library that reads such files.

Defined results: null and empty texts have no ids, whose digests are those of no
bytes; equal texts fare alike; texts and pieces of any length are encoded whole;
bytes that are no token of their own raise ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable
from itertools import pairwise

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, renamed

#: Pieces whose ids are remembered in a worker, up to ``CACHE_CHARS`` characters each, and pairs.
CACHE_PIECES = 400_000
CACHE_CHARS = 48
CACHE_PAIRS = 2_000_000
#: Above every rank.
NEVER = 1 << 62


def read_ranks(content: bytes) -> dict[bytes, int]:
    """token -> number of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def ascii_pattern(pattern: str) -> str | None:
    """``pattern`` over ASCII texts, for the standard library's faster engine, if its classes are letters and digits alone."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain or "(?i" in plain else plain


class Codec:
    """Encodes and decodes with the tokens of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {n: t for t, n in ranks.items()}
        self.whole = {t.decode("latin-1"): n for t, n in ranks.items()}
        self.pieces = regex.compile(pattern)
        plain = ascii_pattern(pattern)
        self.ascii_pieces = re.compile(plain, re.A) if plain else self.pieces
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple] = {}
        # a token that merging its own bytes does not give is none inside a longer piece
        self.automaton = ahocorasick.Automaton()
        self.reached = {t.decode("latin-1"): n for t, n in ranks.items() if len(self.steps(t)[0]) == 1}
        for letters, n in self.reached.items():
            self.automaton.add_word(letters, (len(letters), n))
        if self.reached:
            self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}

    def steps(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """Merging a few bytes, the adjacent pair of lowest rank first, until none is left: the tokens at the end, and of
        every step the rank and the tokens that are first and last after it."""
        parts, taken = [bytes([b]) for b in data], []
        while len(parts) > 1:
            found = [(r, k) for k, (a, b) in enumerate(pairwise(parts)) if (r := self.ranks.get(a + b)) is not None]
            if not found:
                break
            r, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            taken.append((r, parts[0], parts[-1]))
        return parts, taken

    def beside(self, a: int, b: int) -> bool:
        """Whether the tokens may be neighbours: the steps that make them, taken together by rank and from the left, never
        reach one where the last part of ``a`` and the first of ``b`` would merge."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._beside(self._made(a), self._made(b))
        return found

    def _made(self, n: int) -> tuple[bytes, bytes, list[tuple[int, bytes, bytes]]]:
        found = self.made.get(n)
        if found is None:
            data = self.token[n]
            found = self.made[n] = (data[:1], data[-1:], [*self.steps(data)[1], (NEVER, b"", b"")])
        return found

    def _beside(self, a, b) -> bool:
        (_, last, left), (first, _, right) = a, b
        i = j = 0
        while True:
            across = self.ranks.get(last + first, NEVER)
            while True:
                x, y = left[i], right[j]
                if across < x[0] and across <= y[0]:
                    return False
                if x[0] <= y[0]:
                    if x[0] == NEVER:
                        return True
                    i += 1
                    if x[2] != last:
                        last = x[2]
                        break
                else:
                    j += 1
                    if y[1] != first:
                        first = y[1]
                        break

    def prefix(self, n: int) -> int:
        """The longest token that the token begins with, besides itself, or -1."""
        found = self.shorter.get(n)
        if found is None:
            letters = self.token[n].decode("latin-1")
            found = next((m for k in range(len(letters) - 1, 0, -1) if (m := self.reached.get(letters[:k])) is not None), -1)
            self.shorter[n] = found
        return found

    def piece(self, letters: str) -> list[int]:
        """The ids of a piece, given as Latin-1 letters."""
        n = self.whole.get(letters)
        if n is not None:
            return [n]
        size = len(letters)
        longest = [-1] * size
        for end, (length, n) in self.automaton.iter(letters) if self.reached else ():
            longest[end - length + 1] = n  # later ends are longer
        lengths, beside, prefix = self.token, self.beside, self.prefix
        out, ends = [], [0]
        dead = bytearray(size + 1)
        at, n = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while n >= 0:
                end = at + len(lengths[n])
                if not dead[end] and (last < 0 or beside(last, n)):
                    break
                n = prefix(n)
            if n >= 0:
                out.append(n)
                ends.append(end)
                at = end
                n = longest[at] if at < size else -1
            elif not out:
                raise ValueError("no token for a byte")
            else:  # nothing may follow: this place is given up, and the token that led here
                dead[at] = 1
                n = prefix(out.pop())
                ends.pop()
                at = ends[-1]
        return out

    def encode(self, text: str | None) -> array:
        """The ids of a text."""
        out = array("I")
        if not text:
            return out
        known = self.known
        plain = text.isascii()
        for p in (self.ascii_pieces if plain else self.pieces).findall(text):
            ids = known.get(p)
            if ids is None:
                ids = tuple(self.piece(p if plain else p.encode().decode("latin-1")))
                if len(p) <= CACHE_CHARS:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[p] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def _codec(key: str, shipped) -> Codec:
    """One codec a worker process and vocabulary; what it remembers outlives the task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shipped.value)
    return _codecs[key]


def _with(df: DataFrame, path: str, pattern: str, column: str, outputs: T.StructType, fn: Callable) -> DataFrame:
    """``df`` with ``outputs``: what ``fn(codec, value)`` makes of ``column``. The rank file is read on the driver and sent
    once to every executor (under a MB, fixed)."""
    with open(path, "rb") as f:
        content = f.read()
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast((read_ranks(content), pattern))

    def factory():
        codec = _codec(key, shipped)
        return lambda value: fn(codec, value)

    return add_columns(df, [column], outputs, factory)


def encoded(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of every text."""
    outputs = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType()))])
    return _with(docs, path, pattern, text_col, outputs, lambda codec, text: (codec.encode(text).tolist(),))


def decoded(rows: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", name: str = "bytes") -> DataFrame:
    """``rows`` with the bytes that every array of ids stands for; null is no ids."""
    outputs = T.StructType([T.StructField(name, T.BinaryType())])
    return _with(rows, path, pattern, ids_col, outputs, lambda codec, ids: (codec.decode(ids or ()),))


def _digests(codec: Codec, text: str | None) -> tuple[int, str, str]:
    ids = codec.encode(text)
    packed = ids.tobytes() if array("I", [1]).tobytes() == b"\1\0\0\0" else b"".join(n.to_bytes(4, "little") for n in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def query(spark: SparkSession, documents: DataFrame, path: str, pattern: str) -> DataFrame:
    outputs = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    rows = _with(renamed(documents, doc_id="doc_id", text="text"), path, pattern, "text", outputs, _digests)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
