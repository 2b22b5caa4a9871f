"""The corpus pipeline: documents in, training mixture out.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again before the next. All
but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty one; a null text
counts as empty and a null lang or source as unknown; texts of any length are
read whole; further columns are carried along under their own names, whatever
these are; what holds of one stage alone is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfloom.llm import decontam, exact_dedup, mixing, quality, shingles
from shelfloom.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more. Equal texts fare alike; the
    score of an empty text is that of the model's bias; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id; a row without id stays only
    where no row of its text has one; of rows that repeat id and text one stays."""
    return exact_dedup.keep_largest(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles are 0.8 similar or
    more, directly or through others: that of the smallest id, ties by the text's
    digest. Empty texts are one group."""
    return shingles.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Equal texts fare alike;
    empty texts stay; without items all stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: rows once for each epoch that takes them, with domain, epoch and
    n_tokens, which replace columns of these names. Rows that repeat an id are
    taken one by one; those that repeat id and text, as many as the quota needs."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: A trained classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
