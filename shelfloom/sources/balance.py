"""Partitions of about equal weight, whatever the rows weigh.

Rows get a running total of their weights and go to the partition in which
their middle falls, as if they were laid end to end on a line that is cut into
equal lengths. The total is a sum over ``BINS`` bins by hash, the bins' sums added up
before it, and a running sum inside the bin, so no task orders more than a bin.
With rows of at most the mean weight a partition has under twice the mean; a row
that weighs more has a partition that only light rows share.

Defined results: null and negative weights count as 0; rows that weigh nothing go
anywhere; repeated rows are rows of their own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
#: Bytes that a partition is meant to read.
TARGET = 256 << 20


def partitions_for(total: int, least: int, target: int = TARGET) -> int:
    """How many partitions of ``target`` the total makes, but at least ``least``."""
    return max(1, least, -(-total // target))


def balanced(rows: DataFrame, weight: Column, key: str, parts: int | None = None, target: int = TARGET) -> DataFrame:
    """``rows`` in ``parts`` partitions of about equal weight (as many as ``target`` asks for, and no fewer than there
    are cores). ``key`` is a column that tells most rows apart."""
    names = {c: f"in_{k}" for k, c in enumerate(rows.columns)}
    w = F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0))
    laid = rows.select(w.alias("_w"), F.pmod(F.xxhash64(key), F.lit(BINS)).alias("_bin"), *[F.col(c).alias(n) for c, n in names.items()])
    bins = laid.groupBy("_bin").agg(F.sum("_w").alias("_sum"))
    upto = F.sum("_sum").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # at most BINS rows
    found = bins.select("_bin", "_sum", upto.alias("_upto")).collect()
    total = sum(r["_sum"] for r in found)
    parts = parts or partitions_for(total, rows.sparkSession.sparkContext.defaultParallelism, target)
    starts = F.array(*[F.lit(x).cast("long") for x in _starts(found)])
    running = F.sum("_w").over(Window.partitionBy("_bin").orderBy(names[key]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.element_at(starts, F.col("_bin").cast("int") + 1) + running - F.col("_w") / 2
    part = F.least(F.floor(middle * parts / max(1, total)), F.lit(parts - 1)).cast("int")
    dealt = laid.withColumn("_part", part).repartitionById(parts, "_part")
    return dealt.select(*names.values()).toDF(*rows.columns)


def _starts(found) -> list[int]:
    out = [0] * BINS
    for r in found:
        out[r["_bin"]] = r["_upto"] - r["_sum"]
    return out
