"""Language identification: multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader under elastic-net
penalties, then calibrated by one temperature.

N-grams of 1 to 3 characters of the lower-cased text, every run of characters
that are no letters counting as one blank and one blank standing at both ends,
are hashed into ``DIM`` numbers. The document frequencies behind the weights
are counted over all rows that may be learnt from; the weights themselves are
fitted on a sample of bounded size.

Defined results: ``und`` with score 0 where the text is null or has no letter,
and everywhere if there is nothing to learn from; with a single learnt language
that language with score 1; ties go to the language that sorts first; whole
texts count, in blocks that make no difference to the result; repeated rows get
equal results and count once in the sample; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, class_sizes, renamed, ship, thinned, unit_hash
from shelfloom.llm.ftrl import Ftrl, probabilities
from shelfloom.llm.quality import held_out

DIM = 1 << 16
#: Bound of the training sample: at most so many rows of each language.
TRAIN_PER_LANGUAGE = 600
EPOCHS = 3
BLOCK = 1 << 16
_OTHER = re.compile(r"[\W\d_]+")
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(64 - 16)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the whole text and how often each occurs."""
    plain = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4")
    total = None
    for start in range(0, len(codes), BLOCK):
        # the n-grams that begin in this block; the last two may end in the next
        c = codes[start : start + BLOCK + 2].astype(np.uint64)
        one = c * _P[0]
        two = (one[:-1] ^ np.uint64(2)) * _P[1] + c[1:] * _P[3]
        three = (two[:-1] ^ np.uint64(3)) * _P[2] + c[2:] * _P[3]
        h = np.concatenate([one[:BLOCK], two[:BLOCK], three[:BLOCK]])
        h ^= h >> np.uint64(31)
        found = ((h * _P[1]) >> _SHIFT).astype(np.uint16)
        if len(codes) <= BLOCK:
            i, n = np.unique(found, return_counts=True)
            return i.astype(np.int64), n
        total = np.bincount(found, minlength=DIM) + (0 if total is None else total)
    i = np.flatnonzero(total)
    return i, total[i]


def sparse_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    if not text or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64), np.empty(0)
    i, n = counts(text)
    return i, n.astype(float)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the rows of ``texts`` (_text) each n-gram number occurs,
    and the number of rows with any. Every task adds up its own rows; ``DIM``
    sums reach the driver, whatever the size of the table."""
    ship(texts.sparkSession)

    def run(batches):
        seen, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                i, _ = sparse_counts(text)
                seen[i] += 1
                rows += len(i) > 0
        i = np.flatnonzero(seen)
        if len(i):
            yield pa.RecordBatch.from_pydict({"i": pa.array([*i.tolist(), DIM], pa.int32()), "n": pa.array([*seen[i].tolist(), rows], pa.int64())})

    sums = texts.select("_text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM + 1, np.int64)
    out[sums["i"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out[:DIM], int(out[DIM])


def tfidf(i: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[i]
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


class Model:
    """Languages in sorted order, their weights, the idf and the temperature."""

    def __init__(self, languages: list[str], idf=None, weights=None, bias=None, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        i, n = sparse_counts(text)
        if not len(i) or not self.languages:
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        logits = self.weights[:, i] @ tfidf(i, n, self.idf) + self.bias
        p = probabilities(logits[None, :] / self.temperature)[0]
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def train(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = TRAIN_PER_LANGUAGE,
    seed: int = 5,
) -> Model:
    """Learn from all rows of ``documents`` that have a language: n-gram
    statistics over all of them, weights through a sample of ``per_language``
    different rows of each language at most. Executors make the sparse counts,
    the driver gets those of the sample."""
    known = renamed(documents, _id=id_col, _text=text_col, _lang=lang_col).filter(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull()
    )
    sizes = class_sizes(known, "_lang", F.xxhash64("_id", "_text"))
    if len(sizes) < 2:
        return Model(sorted(sizes))
    out = T.StructType([T.StructField("_i", T.BinaryType()), T.StructField("_n", T.BinaryType())])

    def factory():
        def one(text):
            i, n = sparse_counts(text)
            return i.astype("<i4").tobytes(), n.astype("<f4").tobytes()

        return one

    few = thinned(known.withColumn("_h", unit_hash("_id", "_text")), "_lang", F.col("_h"), sizes, per_language)
    # Equal rows have become one; about 1.2 * per_language rows a language are left to be numbered.
    few = few.groupBy("_lang", "_h").agg(F.min("_text").alias("_text"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))
    few = few.withColumn("_k", first).filter(F.col("_k") <= per_language)
    few = few.select("_lang", "_h", "_text").repartition(few.sparkSession.sparkContext.defaultParallelism)  # a language is one partition by now
    made = add_columns(few, ["_text"], out, factory)
    rows = made.select("_h", "_lang", "_i", "_n").collect()
    rows = sorted((r for r in rows if len(r._i)), key=lambda r: (r._h, r._lang, r._i))
    languages = sorted({r._lang for r in rows})
    if len(languages) < 2:
        return Model(languages)
    vectors = [(np.frombuffer(r._i, "<i4"), np.frombuffer(r._n, "<f4")) for r in rows]
    seen, of = document_frequencies(known)
    idf = np.log((1 + of) / (1 + seen)) + 1.0
    place = {x: k for k, x in enumerate(languages)}
    examples = [(i, tfidf(i, n, idf), place[r._lang], 1.0) for (i, n), r in zip(vectors, rows, strict=True)]
    # every tenth example of a language calibrates and is not fitted
    nth: dict[int, int] = {}
    aside, fitted = [], []
    for e in examples:
        nth[e[2]] = nth.get(e[2], 0) + 1
        (fitted if nth[e[2]] % 10 else aside).append(e)
    model = Ftrl(len(languages), DIM, alpha=1.0, l1=1e-3, l2=1e-2)
    model.fit(fitted, EPOCHS, seed)
    weights, bias = model.weights()
    aside = aside or examples
    logits = np.array([weights[:, i] @ v + bias for i, v, _, _ in aside])
    target = np.array([t for _, _, t, _ in aside])
    return Model(languages, idf, weights, bias, temperature(logits, target))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, of 160 between 0.05
    and 10."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(10.0), 160))
    loss = [-np.log(probabilities(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``."""
    weights = model.weights if model.weights is None else model.weights.astype(np.float32)
    # languages x DIM numbers of 4 bytes: a quarter MiB a language, whatever the size of the table
    model = Model(model.languages, model.idf, weights, model.bias, model.temperature)
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return add_columns(documents, [text_col], out, lambda: shipped.value.predict)


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    aside = held_out("doc_id", 4, 2)
    model = train(documents.filter(~aside))
    found = predict(renamed(documents, doc_id="doc_id", text="text"), model)
    return found.select("doc_id", aside.alias("held_out"), "lang_pred", "score")
