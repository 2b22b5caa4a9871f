"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are lower-cased and every run of signs and blanks becomes one
blank. An item is read as overlapping windows of ``WINDOW`` characters, half a
window apart, and as passages: from every word start ``WORDS`` words, or ``SHORT``
characters where those are fewer. So every run of ``WORDS`` words of an item holds
a whole window. A window with an edit budget of ``e`` edits that occurs in a text
shares at least ``len - q + 1 - e * q`` of its q-grams with it, and they lie on
diagonals no more than ``e`` apart. The operator counts shared q-grams in
overlapping bands of diagonals, keeps the bands that meet that bound, and
verifies each by alignment inside the band. A text holds an item if it holds
one of its windows.

The items are a query set, shipped to the tasks in blocks of ``BLOCK_CHARS``
characters, as q-grams of each item, not of each window. One block is one pass
over the texts. Of several, the first pass is against a map of fixed size of all
items' q-grams: only texts with a stretch that has as many of them as the least
window asks for are kept, each once, and the blocks' passes, one after another,
each written and its index freed before the next, go over these. The map knows
every q-gram, so no text is lost by it.

Defined results: null and empty texts hold nothing; items with fewer than ``Q``
characters are too short to be evidence and match nothing; items under one
window count as a whole; items without text are skipped, items without id count
together under the null id; items that repeat an id add up; repeated rows get
equal results; texts of any length are read whole, in pieces that make no
difference to the result; an empty table, of either kind, gives no rows and
marks none.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, fenced, materialise, renamed, ship

Q = 12
#: The map of all items' q-grams has 2 to this power bits (16 MiB), whatever the items.
MAP_BITS = 27
WINDOW = 80
#: The smallest passage of a longer item that counts: so many words, or so many characters from a word start.
WORDS, SHORT = 13, 64
EDITS = 0.05
BAND = 16
BLOCK_CHARS = 1 << 22
PIECE = 1 << 18
#: Places of items that the hits of a piece make, about as many as are held at a time; pieces with more are halved down
#: to ``LEAST_PIECE`` characters.
HELD = 1 << 20
LEAST_PIECE = 1 << 10
#: Where a passage may start; scripts without blanks get starts within their long runs.
_START = re.compile(r"\S{1,16}")
_GAP = re.compile(r"[\W_]+")
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def plain(text: str) -> str:
    return _GAP.sub(" ", text.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` (12) characters from every position."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    two = codes[:-1] * _P[0] + codes[1:] * _P[1]
    two ^= two >> np.uint64(29)
    four = two[:-2] * _P[2] + two[2:] * _P[3]
    four ^= four >> np.uint64(32)
    eight = four[:-4] * _P[0] + four[4:] * _P[1]
    twelve = eight[:-4] * _P[2] + four[8:] * _P[3]
    return twelve ^ (twelve >> np.uint64(31))


def windows(item: str) -> list[str]:
    """Overlapping windows of a plain item, each text once."""
    return list(dict.fromkeys(item[a:b] for a, b in spans(item)))


def spans(item: str) -> list[tuple[int, int]]:
    """(start, end) of the windows; the last one of ``WINDOW`` characters ends
    with the item."""
    if len(item) <= WINDOW:
        out = [(0, len(item))]
    else:
        out = [(s, s + WINDOW) for s in [*range(0, len(item) - WINDOW, WINDOW // 2), len(item) - WINDOW]]
    return out + passages(item)


def passages(item: str) -> list[tuple[int, int]]:
    """The smallest passages that count, from every word start of an item that
    is longer than one."""
    ends = [m.end() for m in re.finditer(r"\S+", item)]
    out, k = [], 0
    for m in _START.finditer(item):
        while ends[k] < m.end():
            k += 1
        stops = [m.start() + SHORT] if m.start() + SHORT <= len(item) else []
        stops += ends[k + WORDS - 1 : k + WORDS]
        # a passage under Q characters is no evidence
        if stops and min(stops) - m.start() >= Q:
            out.append((m.start(), m.start() + len(item[m.start() : min(stops)].rstrip())))
    return out


def budget(length: int) -> int:
    """Edits allowed, few enough for the lemma to ask for one q-gram at least."""
    return min(int(length * EDITS), (length - Q) // Q)


class Index:
    """q-grams of a block of items, each stored once: a window is a stretch of
    its item, not a copy. ``items``: (id, plain text)."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.text, self.windows, self.need, self.edits = [], [], [], [], []
        hashes, owner, at = [], [], []
        for item, text in items:
            found = sorted({text[a:b]: (a, b) for a, b in reversed(spans(text)) if b - a >= Q}.values())
            if not found:
                continue
            # only the q-grams that lie in a window, of which an item that repeats itself has few
            step = np.zeros(len(text) + 2, np.int64)
            for a, b in found:
                step[a] += 1
                step[b - Q + 1] -= 1
            inside = np.flatnonzero(np.cumsum(step) > 0)
            hashes.append(qgrams(_codes(text))[inside])
            owner.append(np.full(len(inside), len(self.ids), np.int32))
            at.append(inside.astype(np.int32))
            self.ids.append(item)
            self.text.append(text)
            w = np.array(found, np.int64)
            edits = np.array([budget(b - a) for a, b in found], np.int64)
            self.windows.append(w)
            self.edits.append(edits)
            # q-grams that a window shares with any text that holds it
            self.need.append(w[:, 1] - w[:, 0] - Q + 1 - edits * Q)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int32))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int32))[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.most = np.array([e.max() for e in self.edits], np.int64)
        self.least = np.array([n.min() for n in self.need], np.int64)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places of the text, q-grams of the index) that are the same."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        h = qgrams(_codes(text))
        i = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)]) if len(self.hash) else none[0]
        if not len(i):
            return none
        k = np.searchsorted(self.hash, h[i])
        k[k == len(self.hash)] = 0
        hit = self.hash[k] == h[i]
        return i[hit], k[hit]

    def bands(self, i: np.ndarray, k: np.ndarray, open_: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, window, band) of the open items that share enough
        q-grams with a text, given its ``hits``."""
        many = self.many[k]
        upto = np.cumsum(many)
        held: list[np.ndarray] = []
        a = 0
        while a < len(i):  # so many hits at a time as make HELD places of items
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD, "right")))
            held.append(self._places(i[a:b], k[a:b], open_))
            if len(held) > 1:  # the places of a band count once, however often the text repeats them
                held = [np.unique(np.concatenate(held, axis=1), axis=1)] if sum(x.shape[1] for x in held) > HELD else held
            a = b
        if not held:
            return []
        owner, band, at = np.concatenate(held, axis=1)
        order = np.lexsort((at, band, owner))
        owner, band, at = owner[order], band[order], at[order]
        same = (owner[1:] == owner[:-1]) & (band[1:] == band[:-1])
        fresh = np.concatenate([[True], ~(same & (at[1:] == at[:-1]))])[: len(owner)]
        owner, band, at = owner[fresh], band[fresh], at[fresh]
        if not len(owner):
            return []
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (band[1:] != band[:-1])) + 1
        start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(owner)]])
        enough = stop - start >= self.least[owner[start]]
        out = []
        for a, b in zip(start[enough].tolist(), stop[enough].tolist()):
            k = int(owner[a])
            w = self.windows[k]
            # places of the band that lie in each window
            n = np.searchsorted(at[a:b], w[:, 1] - Q, "right") - np.searchsorted(at[a:b], w[:, 0])
            out += [(k, x, int(band[a])) for x in np.flatnonzero(n >= self.need[k]).tolist()]
        return out

    def _places(self, i: np.ndarray, k: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """[owner, band, place in the item] of some hits, in rows of 32-bit numbers."""
        many = self.many[k]
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        place = np.repeat(i, many)
        owner = self.owner[entry]
        wanted = open_[owner]
        owner, at = owner[wanted], self.at[entry[wanted]]
        diagonal = (place[wanted] - at).astype(np.int32)
        band = diagonal // BAND
        # bands overlap: the first diagonals of one also belong to the one before
        shared = diagonal - band * BAND < self.most[owner]
        return np.stack([np.concatenate([x, x[shared] - d]).astype(np.int32) for x, d in ((owner, 0), (band, 1), (at, 0))])

    def found(self, text: str | None) -> dict:
        """item id -> number of its windows that the whole text holds."""
        out: dict = {}
        whole = plain(text) if text else ""
        left = [len(w) for w in self.windows]
        open_ = np.ones(len(left), bool)
        held: set[tuple[int, int]] = set()
        # pieces overlap by more than a window with its edits; one found in both counts once
        todo = [(s, min(len(whole), s + PIECE)) for s in range(0, len(whole), PIECE)][::-1]
        while todo and open_.any():
            s, e = todo.pop()
            part = whole[s : e + WINDOW + 4 * BAND]
            i, k = self.hits(part)
            if int(self.many[k].sum()) > HELD and e - s > LEAST_PIECE:
                # much that repeats: what its beginning holds need not be looked for in the rest
                middle = s + LEAST_PIECE if (e - s) <= 4 * LEAST_PIECE else s + (e - s) // 4
                todo += [(middle, e), (s, middle)]
                continue
            for k, w, band in self.bands(i, k, open_):
                if (k, w) in held:
                    continue
                a, b = self.windows[k][w].tolist()
                edits = int(self.edits[k][w])
                # a band is of diagonals to the item's start
                if aligned(self.text[k][a:b], part, band * BAND + a, BAND + edits, edits):
                    held.add((k, w))
                    out[self.ids[k]] = out.get(self.ids[k], 0) + 1
                    left[k] -= 1
                    open_[k] = left[k] > 0
        return out


def aligned(pattern: str, text: str, start: int, width: int, edits: int) -> bool:
    """Whether ``pattern`` matches somewhere in ``text`` with at most ``edits``
    edits, on diagonals ``start - edits`` to ``start + width + edits``."""
    low, high = start - edits, start + width + edits
    if text.find(pattern, max(0, low), max(0, high + len(pattern))) >= 0:
        return True
    far = edits + 1
    span = high - low + 1
    # row[d]: edits to match a prefix of the pattern ending at text position prefix + low + d
    row = [0 if 0 <= low + d <= len(text) else far for d in range(span)]
    for j, c in enumerate(pattern):
        new = [far] * span
        for d in range(span):
            at = j + low + d
            best = far
            if 0 <= at < len(text):
                best = row[d] + (text[at] != c)
            if d + 1 < span and row[d + 1] + 1 < best:
                best = row[d + 1] + 1  # a character of the pattern is missing
            if d and new[d - 1] + 1 < best and 0 < at + 1 <= len(text):
                best = new[d - 1] + 1  # a character of the text is extra
            new[d] = best
        if min(new) > edits:
            return False
        row = new
    return min(row) <= edits


def blocks(benchmark: DataFrame, *, id_col: str, text_col: str, size: int = BLOCK_CHARS):
    """The items in blocks of bounded size, one block at a time on the driver."""
    held, chars = [], 0
    for r in renamed(benchmark, _id=id_col, _text=text_col).filter("_text is not null").toLocalIterator():
        text = plain(r._text).strip()
        held.append((r._id, text))
        chars += len(text)
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _window_grams(text: str) -> tuple[np.ndarray, int]:
    """The q-grams in an item's windows, and how many of them its least window asks of a text; 0 without windows."""
    found = {text[a:b]: (a, b) for a, b in reversed(spans(text)) if b - a >= Q}.values()
    if not found:
        return np.empty(0, np.uint64), 0
    step = np.zeros(len(text) + 2, np.int64)
    for a, b in found:
        step[a] += 1
        step[b - Q + 1] -= 1
    return qgrams(_codes(text))[np.cumsum(step)[: len(text) - Q + 1] > 0], min(b - a - Q + 1 - budget(b - a) * Q for a, b in found)


def candidates(texts: DataFrame, benchmark: DataFrame, *, text_col: str) -> DataFrame:
    """(_text): the different texts of ``texts`` (_text) that may hold an item, by a map of ``MAP_BITS`` bits."""
    ship(texts.sparkSession)

    def grams(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h, least = _window_grams(plain(text or "").strip())
                if least:
                    at = np.unique(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), least))], names=["at", "least"])

    found = renamed(benchmark, _text=text_col).mapInArrow(grams, "at long, least long")
    found = materialise(found.groupBy("at").agg(F.min("least").alias("least")), "decontam-grams")
    least = found.agg(F.min("least")).first()[0]
    if least is None:
        return texts.limit(0)
    # MAP_BITS bits reach the driver, in pieces that tasks have made
    pieces = found.groupBy(F.floor(F.col("at") / 32768).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    known = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        known[r.piece * 4096 : (r.piece + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    shipped = texts.sparkSession.sparkContext.broadcast(known)

    def may_hold(text: str) -> bool:
        there, whole = shipped.value, plain(text)
        for s in range(0, len(whole), PIECE):
            h = (qgrams(_codes(whole[s : s + PIECE + WINDOW + 4 * BAND])) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            if len(h):
                hit = np.concatenate([[0], np.cumsum(there[h >> 3] >> (h & 7).astype(np.uint8) & 1, dtype=np.int64)])
                reach = min(len(h), WINDOW + BAND)
                if (hit[reach:] - hit[: len(hit) - reach]).max() >= least:
                    return True
        return False

    def kept(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array([bool(t) and may_hold(t) for t in part.column(0).to_pylist()], pa.bool_()))

    some = texts.select("_text").mapInArrow(kept, texts.select("_text").schema)
    return materialise(some.dropDuplicates(["_text"]), "decontam-candidates")


def _kind(id_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("n_windows", T.LongType())]))


def _pass(rows: DataFrame, text_col: str, items: list, name: str, id_type: T.DataType):
    """``rows`` with the marks of one block of items, and what to free once
    they are written."""
    shipped = rows.sparkSession.sparkContext.broadcast(Index(items))  # of at most BLOCK_CHARS characters

    def factory():
        index = shipped.value

        def one(text):
            found = index.found(text)
            order = sorted(found, key=lambda i: (i is None, 0 if i is None else i))
            return ([{"item_id": i, "n_windows": found[i]} for i in order],)

        return one

    return add_columns(rows, [text_col], T.StructType([T.StructField(name, _kind(id_type))]), factory), shipped


def _digest(column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256))


def marks(texts: DataFrame, found, id_type: T.DataType) -> DataFrame:
    """(_digest, _item, _n) of the ``texts`` (_text) that hold an item, over several
    blocks of items: one pass over the texts a block, its result written and its index
    freed before the next, so that memory and Python stages stay those of one
    block. Equal texts are marked once."""
    out = None
    for items in found:
        marked, shipped = _pass(texts, "_text", items, "_m", id_type)
        hits = marked.filter(F.size("_m") > 0).select(_digest(F.col("_text")).alias("_digest"), F.explode("_m").alias("_i"))
        hits = materialise(hits.select("_digest", "_i.item_id", "_i.n_windows").distinct(), "decontam-marks")
        shipped.destroy()
        out = hits if out is None else out.unionByName(hits)
    # an item of several rows may lie in several blocks
    return out.groupBy("_digest", F.col("item_id").alias("_item")).agg(F.sum("n_windows").alias("_n"))


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    name: str = "_items",
) -> DataFrame:
    """``docs`` with an array of (item_id, n_windows), empty where clean; it
    replaces a column of the same name, whatever its case."""
    rows, names = fenced(docs)
    text = names[text_col]
    found = blocks(benchmark, id_col=item_col, text_col=item_text_col)
    first = list(itertools.islice(found, 2))
    id_type = renamed(benchmark, _id=item_col).schema["_id"].dataType
    if len(first) < 2:
        out, _ = _pass(rows, text, first[0] if first else [], "_found", id_type)
    else:
        texts = candidates(rows.select(F.col(text).alias("_text")), benchmark, text_col=item_text_col)
        hits = marks(texts, itertools.chain(first, found), id_type).groupBy("_digest").agg(
            F.sort_array(F.collect_list(F.struct(F.col("_item").isNull().alias("last"), F.col("_item").alias("item_id"), F.col("_n").alias("n_windows")))).alias("_all")
        )
        plain_marks = F.transform(F.coalesce(F.col("_all"), F.array().cast(f"array<struct<last:boolean,item_id:{id_type.simpleString()},n_windows:bigint>>")), lambda m: F.struct(m["item_id"].alias("item_id"), m["n_windows"].alias("n_windows")))
        out = rows.withColumn("_key", _digest(F.col(text))).join(hits, F.col("_key") == F.col("_digest"), "left").withColumn("_found", plain_marks)
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns if c.lower() != name.lower()], F.col("_found").alias(name))


def query(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds."""
    rows = marked(renamed(documents, doc_id="doc_id", text="text"), benchmark)
    return rows.select("doc_id", F.explode("_items").alias("_i")).select("doc_id", "_i.item_id", "_i.n_windows")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    rows, names = fenced(docs)
    clean = marked(rows, benchmark, text_col=names["text"]).filter(F.size("_items") == 0)
    return clean.drop("_items").toDF(*docs.columns)
