"""Quality classifier: hashed word n-grams, logistic regression by
follow-the-regularised-leader, scored as sparse dot products.

Two views of the word sequence are hashed into one space: the words themselves
(1- and 2-grams, lower case) and their shapes (1- to 3-grams; letters in upper
or lower case, digits, signs, length class, and whether the word repeats the
one before it). A feature's value is its share of the view's n-grams, so the
score of a text is the mean weight of its n-grams and costs one gather.

Defined results: null and empty texts have no n-grams and get the score of the
bias alone; texts of any length are read whole, in blocks of words that make no
difference to the result; repeated rows get equal scores; without labelled rows
of both classes the model is the prior (or 0.5 without any). Labels that are
neither 0 nor 1 are not learnt from, nor are labels without an id. Different
labels of one id all count; equal ones count once in the sample. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, capped, class_sizes, fenced, renamed, thinned, unit_hash
from shelfloom.llm.ftrl import Ftrl, probabilities

DIM = 1 << 18
#: Bound of the training sample: at most so many labelled rows of each class.
TRAIN_PER_CLASS = 2500
EPOCHS = 4
SCALE = 8.0
BLOCK_WORDS = 1 << 16
CARRY = 3
CACHE_WORDS = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _shape(word: str) -> int:
    """A small number: kind of the characters and a length class."""
    first = word[0]
    if not (first.isalnum() or first == "_"):
        return 16 + (zlib.crc32(first.encode("utf-8", "replace")) % 61) * 4 + min(len(word), 4) - 1
    if word.isdigit():
        return 1
    if word.isupper():
        return 2 + (len(word) > 1)
    kind = 4 if word.islower() else 5 if word[1:].islower() else 6
    return kind + 4 * (len(word) > 12)


class _Words(dict):
    """word -> hash of its lower case in the high half, shape in the low half."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        low = word.lower().encode("utf-8", "surrogatepass")
        value = self[word] = zlib.crc32(low) << 32 | _shape(word)
        return value


def _grams(codes: np.ndarray, old: int = 0) -> list[np.ndarray]:
    """Feature numbers of one block of words: word view, then shape view. The
    first ``old`` words are those of the block before; n-grams that end there
    have been counted."""
    word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(word), np.uint64)
    same[1:] = word[1:] == word[:-1]
    shape = shape * np.uint64(2) + same

    def number(salt: int, view: np.ndarray, n: int) -> np.ndarray:
        first = max(0, old - n + 1)
        stop = max(first, len(view) - n + 1)
        h = np.full(stop - first, salt, np.uint64)
        for k in range(n):
            h = (h ^ view[first + k : stop + k]) * _M1
            h ^= h >> np.uint64(29)
        return ((h * _M2) >> np.uint64(46)).astype(np.int64)

    return [number(1, word, 1), number(2, word, 2), number(3, shape, 1), number(4, shape, 2), number(5, shape, 3)]


def _blocks(text: str | None, words: _Words):
    """Feature numbers of the whole text, block by block. Each block begins
    with the three words before it: an n-gram reaches back by two, and whether
    the first of these repeats its own predecessor takes a third. Every n-gram
    is counted once, wherever the blocks end."""
    if not text:
        return
    codes: list[int] = []
    old = 0
    for m in _TOKEN.finditer(text):
        codes.append(words[m[0]])
        if len(codes) >= BLOCK_WORDS + old:
            yield _grams(np.array(codes, np.uint64), old)
            codes = codes[-CARRY:]
            old = len(codes)
    if len(codes) > old:
        yield _grams(np.array(codes, np.uint64), old)


def features(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values."""
    views = [[], [], [], [], []]
    for block in _blocks(text, words):
        for view, grams in zip(views, block, strict=True):
            view.append(grams)
    idx, val = [], []
    for view in views:
        total = sum(map(len, view))
        if total:
            i, n = np.unique(np.concatenate(view), return_counts=True)
            idx.append(i)
            val.append(n * (SCALE / total))
    if not idx:
        return np.empty(0, np.int64), np.empty(0)
    i, inverse = np.unique(np.concatenate(idx), return_inverse=True)
    return i, np.bincount(inverse, np.concatenate(val), minlength=len(i))


def score_text(text: str | None, weights: np.ndarray, bias: float, words: _Words) -> float:
    total, count = [0.0] * 5, [0] * 5
    for block in _blocks(text, words):
        for v, grams in enumerate(block):
            total[v] += float(weights[grams].sum())
            count[v] += len(grams)
    logit = bias + sum(SCALE * t / n for t, n in zip(total, count, strict=True) if n)
    return float(probabilities(np.array([[logit]]))[0, 0])


def train(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = TRAIN_PER_CLASS,
    held_out: F.Column | None = None,
    seed: int = 11,
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``held_out`` is a condition on ``id_col``; its rows
    are never learnt from. The sample holds ``per_class`` rows a class at most,
    however often an id or a row repeats; its features are made by the executors
    and reach the driver as sparse vectors."""
    known = labels if held_out is None else labels.filter(~held_out)
    known = renamed(known, _id=id_col, _label=label_col).filter(
        F.col("_label").isin(0, 1) & F.col("_id").isNotNull()
    )
    sizes = class_sizes(known, "_label", F.xxhash64("_id"))
    sample = thinned(known.withColumn("_h", unit_hash("_id")), "_label", F.col("_h"), sizes, per_class).distinct()
    sample = capped(sample, "_label", ["_h", "_id"], sizes, per_class)
    texts = renamed(documents, _doc=id_col, _text=text_col)
    # The sample holds at most 2 * per_class ids, whatever the size of the tables.
    joined = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    # An id may have any number of rows, so the rows are capped as well.
    joined = capped(joined, "_label", ["_h", "_id", "_text"], sizes, per_class)
    joined = joined.repartition(joined.sparkSession.sparkContext.defaultParallelism)  # a class is one partition by now
    out = T.StructType([T.StructField("_i", T.BinaryType()), T.StructField("_v", T.BinaryType())])

    def factory():
        words = _Words()

        def one(text):
            i, v = features(text, words)
            return i.astype("<i4").tobytes(), v.astype("<f4").tobytes()

        return one

    made = add_columns(joined.select("_id", "_label", "_text"), ["_text"], out, factory)
    rows = sorted(made.select("_id", "_label", "_i", "_v").collect(), key=lambda r: (r._id, r._label, r._i))
    share = [sum(r._label == c for r in rows) for c in (0, 1)]
    if min(share) == 0:
        prior = 0.0 if max(share) == 0 else 4.0 if share[1] else -4.0
        return np.zeros(DIM, np.float32), prior
    true = {c: sizes[c][0] for c in (0, 1)}  # undo the sampling: weights follow the table
    weight = {c: true[c] / sum(true.values()) * len(rows) / share[c] for c in (0, 1)}
    # views of the bytes that were sent: 8 bytes a feature are all that the driver holds
    examples = [(np.frombuffer(r._i, "<i4"), np.frombuffer(r._v, "<f4"), r._label, weight[r._label]) for r in rows]
    model = Ftrl(1, DIM, alpha=0.3, l1=0.02, l2=0.5)
    model.fit(examples, EPOCHS, seed)
    w, b = model.weights()
    return w[0].astype(np.float32), float(b[0])


def score(
    documents: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", name: str = "score"
) -> DataFrame:
    """``documents`` with the probability of label 1 under ``name``."""
    weights, bias = model
    shipped = documents.sparkSession.sparkContext.broadcast(weights)  # DIM floats: 1 MiB

    def factory():
        words, w = _Words(), shipped.value
        return lambda text: (score_text(text, w, bias, words),)

    return add_columns(documents, [text_col], T.StructType([T.StructField(name, T.DoubleType())]), factory)




def held_out(id_col: str = "doc_id", mod: int = 5, rest: int = 0) -> F.Column:
    """Null ids count as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod == rest


def query(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = train(documents, labels, held_out=held_out())
    scored = score(renamed(documents, doc_id="doc_id", text="text"), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = train(documents, labels, held_out=held_out())
    rows, names = fenced(documents)
    scored = score(rows, model, text_col=names["text"])
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*documents.columns)
