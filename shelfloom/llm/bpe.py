"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a doubly linked list; a heap holds the adjacent
pairs by merge rank and position. The lowest pair is popped and merged until
none is left; the count is the initial symbols minus the merges, and no
identifier is ever made. Counts of short pieces are remembered, up to a bound.

Reads a byte-level BPE file of the ``tokenizers`` library; the settings this
module does not follow raise ``ValueError``. Special strings inside a text are
one token each, as that library counts by default.

Defined results: null and empty texts have 0 tokens; whole texts count,
whatever their length; one piece of any length costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, renamed

#: Fixed value: how byte-level BPE splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over a text of ASCII alone, in the standard library's faster engine.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CACHE_PIECES = 600_000
CACHE_CHARS = 48


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the
    next free character from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


class Counter:
    """Counts tokens of texts with the merges of one vocabulary file."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = spec.get("normalizer") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges")
        special = spec.get("added_tokens", [])
        if not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError("only plain byte-level BPE files are counted")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.special = sorted((t["content"] for t in special), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.ascii_pieces = re.compile(ASCII_PIECES, re.A)
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        letters, rank = self.letters, self.rank
        symbols = [letters[b] for b in text.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        heap = []
        for i in range(n - 1):
            r = rank.get((symbols[i], symbols[i + 1]))
            if r is not None:
                heap.append(r << 40 | i)  # lowest rank first, then leftmost
        if not heap:
            return n
        heapq.heapify(heap)
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if j < 0 or not symbols[i] or rank.get((symbols[i], symbols[j])) != top >> 40:
                continue  # the pair is gone
            merged = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                r = rank.get((merged, symbols[k]))
                if r is not None:
                    heapq.heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = rank.get((symbols[h], merged))
                if r is not None:
                    heapq.heappush(heap, r << 40 | h)
        return n - merges

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        pieces = self.ascii_pieces if text.isascii() else self.pieces
        for m in pieces.finditer(text):
            p = m[0]
            n = known.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) <= CACHE_CHARS:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        total = at = 0
        for m in self.split.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


_counters: dict[str, Counter] = {}


def _counter(key: str, shipped) -> Counter:
    """One counter per worker process and vocabulary: its memory of pieces
    outlives the task."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(shipped.value)
    return _counters[key]


def with_counts(docs: DataFrame, path: str, *, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of every text. The vocabulary file is read
    on the driver and shipped once to every executor (a few MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    spec, key = json.loads(content), hashlib.sha256(content.encode()).hexdigest()
    spec["model"] = {k: v for k, v in spec["model"].items() if k != "vocab"}
    shipped = docs.sparkSession.sparkContext.broadcast(spec)

    def factory():
        counter = _counter(key, shipped)
        return lambda text: (counter.count(text),)

    return add_columns(docs, [text_col], T.StructType([T.StructField(name, T.LongType())]), factory)


def query(spark: SparkSession, documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    rows = with_counts(renamed(documents, doc_id="doc_id", text="text"), path)
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
