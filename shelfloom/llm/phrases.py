"""Collocations by pivot partitioning.

Words are 64-bit hashes of (language, word), proved free of collisions over the
whole vocabulary before they are used: where two words share one, everything is
done again under another seed. The vocabulary's counts give an order of words
from rare to frequent. A phrase belongs to its rarest word, the pivot. For every
occurrence of a word, a task cuts out the fragment in which that word is the
rarest: up to ``max_words - 1`` words on either side, ended by a rarer word or by
the end of the piece. Equal fragments are added up before they are shuffled. They
go to their pivot, where phrases that hold the pivot are counted, pairs first and
longer phrases only where their pairs are frequent; no other pivot sees them.

The order comes from a table of ``SLOTS`` counters (16 MB whatever the corpus),
in which frequent words that share a slot are added up. Any order of words
gives right counts, as it only says where a phrase is counted; words in an empty
slot are too rare for any phrase. A pivot with more than ``SPLIT`` occurrences has
several parts: its fragments are taken apart into phrases where they are cut, which
are added up there, and each phrase goes whole to the part that its own words name,
so neither a word nor a pair of words is one task's work.

Defined results: null and empty texts have no words, a null language is
``und``; repeated rows count as often as they are there; extra columns are
ignored; an empty table gives no rows. Texts are read whole; a task holds
``CHUNK`` bytes of text at a time, or one piece where that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.llm.common import materialise, renamed, ship
from shelfloom.runtime import discard

CHUNK = 1 << 20
#: Counters of the order of words; a word's slot is the upper bits of its hash.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Occurrences of a pivot that one part takes.
SPLIT = 200_000
#: Rows that a task adds up before it hands them on.
HELD = 400_000
#: Parts of a language where its rows meet what is known of it.
PARTS = 64
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

#: The byte that each byte counts as: A-Z in lower case, ends of pieces as \n, tab as blank.
_AS = np.arange(256, dtype=np.uint8)
_AS[65:91] += 32
_AS[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 10
_AS[9] = 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at + 8`` of every word as one number, zeros past its end. ``data`` has 8 bytes of padding."""
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    return eight[starts + at] & _MASK[np.clip(lengths - at, 0, 8)]


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A hash of every word, never 0; ``salts`` holds one number a word for language and seed."""
    out = _mix((salts + lengths.astype(np.uint64) * _ODD) ^ _blocks(data, starts, lengths, 0))
    rest = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    at = 8
    while len(rest):
        out[rest] = _mix((out[rest] + _ODD) ^ _blocks(data, starts[rest], lengths[rest], at))
        at += 8
        rest = rest[lengths[rest] > at]
    for k in np.flatnonzero(lengths > LONG_WORD):
        word = data[starts[k] : starts[k] + lengths[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=int(salts[k]).to_bytes(8, "little")).digest(), "little")
    return np.maximum(out, np.uint64(1))


def _same(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of the word numbered ``other``."""
    out = lengths == lengths[other]
    rest = np.flatnonzero(out & (lengths <= LONG_WORD))
    at = 0
    while len(rest):
        out[rest] = _blocks(data, starts[rest], lengths[rest], at) == _blocks(data, starts[other[rest]], lengths[other[rest]], at)
        at += 8
        rest = rest[lengths[rest] > at]
    for k in np.flatnonzero(out & (lengths > LONG_WORD)):
        a, b = starts[k], starts[other[k]]
        out[k] = data[a : a + lengths[k]].tobytes() == data[b : b + lengths[k]].tobytes()
    return out


class _Words:
    """The words of a stretch of texts: hashes, whether each follows the one
    before it in a piece, and where they are."""

    def __init__(self, data: np.ndarray, starts, lengths, follows, hashes, texts):
        self.data, self.starts, self.lengths = data, starts, lengths
        self.follows, self.hashes, self.texts = follows, hashes, texts

    def word(self, k: int) -> str:
        a = self.starts[k]
        return self.data[a : a + self.lengths[k]].tobytes().decode()


def _stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK`` bytes that end where a text or a piece does."""
    at, last = 0, int(ends[-1])
    whole = data.tobytes() if last > CHUNK else b""
    while at < last:
        to = at + CHUNK
        if to >= last:
            to = last
        else:
            inner = np.searchsorted(ends, to, "right") - 1  # the last text that ends by then
            cut = max(int(ends[inner]) if inner >= 0 else 0, whole.rfind(b"\n", at, to) + 1)
            if cut <= at:
                piece = whole.find(b"\n", to)
                cut = min(int(ends[inner + 1]), piece + 1 if piece >= 0 else last)
            to = cut
        yield at, to
        at = to


def _words(texts: pa.Array, salts: np.ndarray) -> Iterator[_Words]:
    """All words of ``texts``; ``salts`` has one number a text."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = int(ends[0])
    if int(ends[-1]) == first:
        return
    data = _AS[np.frombuffer(texts.buffers()[2], np.uint8)[first : int(ends[-1])]]
    begins, ends = ends[:-1] - first, ends[1:] - first
    for lo, hi in _stretches(data, ends):
        part = np.concatenate([data[lo:hi], np.full(8, 10, np.uint8)])
        letter = (part[:-8] != 32) & (part[:-8] != 10)
        start, end = letter.copy(), letter.copy()
        inner = begins[(begins > lo) & (begins < hi)] - lo
        fresh = np.zeros(hi - lo, bool)
        fresh[inner] = True
        start[1:] &= ~letter[:-1] | fresh[1:]
        end[:-1] &= ~letter[1:] | fresh[1:]
        starts, stops = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(starts):
            continue
        text = np.searchsorted(begins, starts + lo, "right") - 1
        piece = np.cumsum((part[:-8] == 10) | fresh)[starts]
        follows = np.concatenate([[False], piece[1:] == piece[:-1]])
        lengths = stops - starts
        yield _Words(part, starts, lengths, follows, _hashes(part, starts, lengths, salts[text]), text)


def _salts(langs: pa.Array, seed: int) -> tuple[list[str], np.ndarray]:
    names = [x if x is not None else "und" for x in langs.to_pylist()]
    known = {n: int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8, key=b"%d" % seed).digest(), "little") for n in set(names)}
    return names, np.array([known[n] for n in names], np.uint64)


def _summed(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns of the different rows, their summed weights, the number among
    them of every row)."""
    if not len(weights):
        return columns, weights, np.zeros(0, np.int64)
    mark = reduce(lambda a, c: _mix(a + _ODD) ^ c, columns[1:], columns[0])
    _, first, inverse = np.unique(mark, return_index=True, return_inverse=True)
    if any((c != c[first][inverse]).any() for c in columns):  # two rows share a mark
        order = np.lexsort(columns[::-1])
        new = np.concatenate([[True], reduce(np.logical_or, [c[order][1:] != c[order][:-1] for c in columns])])
        first, inverse = order[new], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, inverse, weights)
    return [c[first] for c in columns], sums, inverse


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def vocabulary(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", first_seed: int = 0) -> tuple[DataFrame, int]:
    """(h, lang, word, n) of every word of each language, written, and the seed
    under which no two of them share a hash."""
    ship(docs.sparkSession)
    rows = renamed(docs, text=text_col, lang=lang_col)
    seed = first_seed
    while True:

        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            held: dict = {}

            def full() -> pa.RecordBatch:
                keys, counts = list(held), list(held.values())
                h, langs, words = zip(*keys, strict=True)
                held.clear()
                columns = [_long(np.array(h, np.uint64)), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["h", "lang", "word", "n"])

            for batch in batches:
                langs, salts = _salts(batch.column(1), seed)
                for w in _words(batch.column(0), salts):
                    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
                    # the same hash in a stretch: the same word of the same language, or else counted by itself
                    same = _same(w.data, w.starts, w.lengths, first[inverse]) & (salts[w.texts] == salts[w.texts[first]][inverse])
                    counts = np.bincount(inverse[same], minlength=len(first))
                    for k in np.flatnonzero(~same):
                        key = (int(w.hashes[k]), langs[w.texts[k]], w.word(k))
                        held[key] = held.get(key, 0) + 1
                    for k, h, n in zip(first.tolist(), w.hashes[first].tolist(), counts.tolist(), strict=True):
                        key = (h, langs[w.texts[k]], w.word(k))
                        held[key] = held.get(key, 0) + n
                    if len(held) >= HELD // 4:
                        yield full()
            if held:
                yield full()

        counted = rows.mapInArrow(count, "h long, lang string, word string, n long").repartition("h")
        words = materialise(counted.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            return words, seed
        discard(words)
        seed += 1


def order_table(words: DataFrame, min_count: int) -> np.ndarray:
    """How often the frequent words of every slot occur. At most ``SLOTS`` rows
    reach the driver, whatever the vocabulary."""
    slot = F.shiftrightunsigned("h", 64 - SLOT_BITS).cast("int").alias("slot")
    found = words.filter(F.col("n") >= min_count).groupBy(slot).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint32)
    out[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 32) - 1)
    return out


def _cut(w: _Words, order: np.ndarray, reach: int, split: int) -> tuple[list[np.ndarray], np.ndarray]:
    """([pivot, part, left 1, ..., right 1, ...], weights): the different fragments of a stretch, 0 where a
    place is empty. The pivot is the first of its word in the fragment."""
    kept = np.flatnonzero(order[w.hashes >> np.uint64(64 - SLOT_BITS)])
    if not len(kept):
        return [], np.zeros(0, np.int64)
    h = w.hashes[kept]
    # a link to the next kept word: the next word of the text, in the same piece
    link = (kept[1:] == kept[:-1] + 1) & w.follows[kept[1:]]
    count = order[h >> np.uint64(64 - SLOT_BITS)]
    n = len(h)
    sides = []
    for step in (-1, 1):
        open_ = np.ones(n, bool)
        for d in range(1, reach + 1):
            column, at = np.zeros(n, np.uint64), np.zeros(n, bool)
            if d < n:
                here, there = (slice(d, n), slice(0, n - d)) if step < 0 else (slice(0, n - d), slice(d, n))
                joint = link[: n - d] if step < 0 else link[d - 1 :]
                rarer = (count[there] > count[here]) | ((count[there] == count[here]) & ((h[there] > h[here]) if step < 0 else (h[there] >= h[here])))
                at[here] = joint & rarer
                open_ &= at
                column[here] = np.where(open_[here], h[there], np.uint64(0))
            else:
                open_[:] = False
            sides.append(column)
    parts = (count // split).astype(np.uint64) + np.uint64(1)
    some = np.flatnonzero(((sides[0] != 0) | (sides[reach] != 0)) & (parts == 1))
    made = [[h[some], np.zeros(len(some), np.uint64), *(c[some] for c in sides)]]
    for size in range(2, reach + 2):
        for a in range(size):
            b = size - 1 - a
            whole = (parts > 1) & ((sides[a - 1] != 0) if a else True) & ((sides[reach + b - 1] != 0) if b else True)
            at = np.flatnonzero(whole)
            # the phrase alone, under a part of its pivot that it names itself
            columns = [c[at] if k < a or reach <= k < reach + b else np.zeros(len(at), np.uint64) for k, c in enumerate(sides)]
            part = _mix(reduce(lambda x, c: _mix(x) ^ c, columns)) % parts[at] + np.uint64(1)
            made.append([h[at], part, *columns])
    columns = [np.concatenate(c) for c in zip(*made, strict=True)]
    columns, weights, _ = _summed(columns, np.ones(len(columns[0]), np.int64))
    return columns, weights


def _names(reach: int) -> list[str]:
    return ["pivot", "part", *(f"l{d}" for d in range(1, reach + 1)), *(f"r{d}" for d in range(1, reach + 1)), "n"]


def fragments(docs: DataFrame, order, seed: int, max_words: int, *, text_col: str = "text", lang_col: str = "lang", split: int = SPLIT) -> DataFrame:
    """The fragments of all texts, each with the number of times that a task met it. ``order`` is a broadcast of ``order_table``."""
    reach = max_words - 1
    names = _names(reach)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def added() -> tuple[list[np.ndarray], np.ndarray]:
            columns = [np.concatenate([c[k] for c, _ in held]) for k in range(len(names) - 1)]
            columns, weights, _ = _summed(columns, np.concatenate([n for _, n in held]))
            return columns, weights

        def full() -> pa.RecordBatch:
            columns, weights = added()
            by = np.argsort(columns[0], kind="stable")  # equal pivots together, which compresses
            return pa.RecordBatch.from_arrays([*(_long(c[by]) for c in columns), _long(weights[by])], names=names)

        for batch in batches:
            _, salts = _salts(batch.column(1), seed)
            for w in _words(batch.column(0), salts):
                columns, weights = _cut(w, order.value, reach, split)
                if len(weights):
                    held.append((columns, weights))
                    rows += len(weights)
                if rows >= HELD:
                    yield full()
                    held, rows = [], 0
        if held:
            yield full()

    schema = ", ".join(f"{c} long" for c in names)
    return renamed(docs, text=text_col, lang=lang_col).mapInArrow(cut, schema)


def _mined(columns: list[np.ndarray], weights: np.ndarray, reach: int, min_count: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(the words of a phrase, counts): every phrase of two words and more with ``min_count`` occurrences in the given
    fragments, which are all of their (pivot, part)."""
    pivot, split = columns[0], columns[1] != 0
    left, right = columns[2 : 2 + reach], columns[2 + reach :]
    words = sum((c != 0).astype(np.int64) for c in left + right) + 1
    # frequent[a, b]: rows whose phrase from a words before the pivot to b words after it is frequent
    frequent = {(0, 0): np.ones(len(weights), bool)}
    for size in range(2, reach + 2):
        for a in range(size):
            b = size - 1 - a
            mask = ((left[a - 1] != 0) if a else True) & ((right[b - 1] != 0) if b else True)
            if a:
                mask = mask & frequent[a - 1, b]
            if b:
                mask = mask & frequent[a, b - 1]
            # a row of a split pivot stands for all of its words and nothing less
            at = np.flatnonzero(mask & (~split | (words == size)))
            found = [*(left[d][at] for d in reversed(range(a))), pivot[at], *(right[d][at] for d in range(b))]
            phrases, counts, number = _summed(found, weights[at])
            enough = counts >= min_count
            flags = split.copy()
            flags[at] = enough[number] if len(at) else False
            frequent[a, b] = flags | split
            yield [c[enough] for c in phrases], counts[enough]


def mine(parts: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """(gram, n) of all phrases of 2 to ``max_words`` words with ``min_count``
    occurrences; gram is the array of hashes."""
    reach, names = max_words - 1, _names(max_words - 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def emit(columns: list[np.ndarray], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
            for words, counts in _mined(columns, weights, reach, min_count):
                if len(counts):
                    flat = np.stack(words, axis=1).reshape(-1).view(np.int64)
                    ends = np.arange(len(counts) + 1, dtype=np.int32) * len(words)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(counts)], names=["gram", "n"])

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            columns = [np.concatenate([b[k] for b in held]) for k in range(len(names))]
            return columns[:-1], columns[-1].view(np.int64)

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            rows += batch.num_rows
            if rows >= HELD // 2:
                columns, weights = joined()
                # all but the last (pivot, part), which may go on
                new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield from emit([c[:cut] for c in columns], weights[:cut])
                # what is left is one (pivot, part): its equal fragments are added up
                columns, weights, _ = _summed([c[cut:] for c in columns], weights[cut:])
                held, rows = [[*columns, weights.view(np.uint64)]], len(weights)
        if held:
            yield from emit(*joined())

    dealt = parts.repartition("pivot", "part").sortWithinPartitions("pivot", "part")
    return dealt.mapInArrow(local, "gram array<long>, n long")


def _with_lang(rows: DataFrame, langs: DataFrame, by: str) -> DataFrame:
    """``rows`` with what ``langs`` has of their language, one row each. The rows of a language are dealt by ``by`` as well, so
    that no task gets all of them."""
    parts = langs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS).cast("long"))).join(parts, ["lang", "_part"]).drop("_part")


def phrases(docs: DataFrame, *, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, text_col: str = "text", lang_col: str = "lang", split: int = SPLIT) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, dropped): every candidate phrase, with its lowest-scoring cut and whether
    a longer candidate stands for it."""
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    spark = docs.sparkSession
    words, seed = vocabulary(docs, text_col=text_col, lang_col=lang_col)
    order = spark.sparkContext.broadcast(order_table(words, min_count))
    grams = materialise(mine(fragments(docs, order, seed, max_words, text_col=text_col, lang_col=lang_col, split=split), max_words, min_count), "phrase-grams")
    order.unpersist()

    often = words.filter(F.col("n") >= min_count)
    counts = materialise(often.select(F.array("h").alias("part"), F.col("n").alias("count")).union(grams), "phrase-counts")
    size = F.size("gram")
    cuts = grams.select("gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("gram", F.lit(1), F.col("k")), "rest": F.slice("gram", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("part").alias("first"), F.col("count").alias("l")), "first")
    cuts = cuts.join(counts.select(F.col("part").alias("rest"), F.col("count").alias("r")), "rest")
    # exact up to 10^15 occurrences
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("gram").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the most frequent candidate that a phrase lies inside of
    inner = grams.filter(size > 2).select("n", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda s: F.transform(F.sequence(F.lit(1), size - s + 1), lambda p: F.slice("gram", p, s))))).alias("gram"))
    around = inner.groupBy("gram").agg(F.max("n").alias("around"))
    best = best.join(around, "gram", "left")
    dropped = F.coalesce(F.lit(100) * F.col("around") >= F.lit(inside_percent) * F.col("a"), F.lit(False))

    spelt = best.select("gram", F.posexplode("gram").alias("at", "h")).join(often.select("h", "lang", "word"), "h")
    spelt = spelt.groupBy("gram").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    out = _with_lang(best.join(spelt, "gram"), totals, "gram")
    return out.select(
        "lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"), size.alias("words"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").alias("score"), dropped.alias("dropped"),
    )


def query(spark: SparkSession, documents: DataFrame, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases. Only rows whose score may be among them are ordered."""
    found = materialise(phrases(documents).filter("not dropped").drop("dropped", "words"), "phrase-scores")
    # a score is 1,000,000 at most: of its thousands, and then of its last digits, the least that the first rows reach
    # into; no task orders more than a thousand rows for it
    above = lambda by: F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scores = materialise(found.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.floor(F.col("score") / 1000)), "phrase-steps")
    steps = scores.groupBy("lang", "step").agg(F.sum("rows").alias("rows")).withColumn("before", above("step"))
    last = steps.filter(F.col("before") < top).groupBy("lang").agg(F.min_by(F.struct("step", "before"), "step").alias("last"))
    fine = _with_lang(scores, last, "score").filter("step = last.step").withColumn("before", F.col("last.before") + above("score"))
    least = fine.filter(F.col("before") < top).groupBy("lang").agg(F.min("score").alias("least"))
    found = _with_lang(found, least, "phrase").filter("score >= least")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p
), one AS (SELECT lang, unnest(w) AS phrase FROM w),
two AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w),
three AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w),
f AS (
  SELECT lang, phrase, 1 AS words, count(*) AS f FROM one GROUP BY ALL
  UNION ALL SELECT lang, phrase, 2, count(*) FROM two GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, phrase, 3, count(*) FROM three GROUP BY ALL HAVING count(*) >= 10
), n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
c AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1
), k AS (
  SELECT *, unnest(range(1, words)) AS k FROM c
), cut AS (
  SELECT k.lang, k.phrase, k.words, k.a, k.k, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.s[1:k.k], ' ')
         JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.s[k.k + 1:], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM c WHERE words = 3
    UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM c WHERE words = 3
  ) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.around IS NULL OR 100 * i.around < 50 * b.a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank, phrase, a, l, r, n.n AS n, score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""
