"""Scan filters as one ordered first-match column, and their summary.

Defined results: a test on a null value fails no file; flags that the table
lacks are not set; rows that repeat a path are judged each; no rows give an
empty summary.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfloom.config import DEFAULT_FILTERS, LIFTABLE, Filters

# Reasons in the order of the tests and of the summary.
REASONS = ("unreadable", "not_regular", "own_output", "hidden", "system", "excluded_pattern", "too_small", "too_large")


def skip_reason(columns: list[str], filters: Filters = DEFAULT_FILTERS) -> Column:
    """The first filter that a file fails, null if it stays. Flags that the
    table lacks count as passed."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in columns else F.lit(False)
    tests: list[tuple[str, Column]] = [("unreadable", has("unreadable")), ("not_regular", has("not_regular"))]
    own = F.lit(False)
    # a prefix counts as it is written and as it is resolved; "reports" is not "reports-old"
    for prefix in dict.fromkeys(p for given in filters.own_output for p in (given, os.path.realpath(given))):
        own = own | F.col("path").startswith(prefix.rstrip("/") + "/")
    tests.append(("own_output", own))
    if not filters.include_hidden:
        tests.append(("hidden", has("hidden")))
    if not filters.include_system:
        tests.append(("system", has("system")))
    if filters.excluded_patterns:
        # one expression, whatever the number of patterns
        tests.append(("excluded_pattern", F.lower("name").rlike("|".join(f"(?:{_regex(p)})" for p in filters.excluded_patterns))))
    if filters.min_size_bytes > 0:
        tests.append(("too_small", F.col("size") < filters.min_size_bytes))
    if filters.max_size_mb > 0:
        tests.append(("too_large", F.col("size") > filters.max_size_mb * 1024 * 1024))
    out = F.lit(None).cast("string")
    for reason, test in reversed(tests):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out


def _regex(pattern: str) -> str:
    """A shell pattern for Java and RE2."""
    text = fnmatch.translate(pattern.lower())
    return text.replace("(?s:", "^(?s:").replace(r"\Z", "$").replace(r"\z", "$").replace("(?>", "(?:")


def scanned(files: DataFrame, extensions: list[str] | None = None, filters: Filters = DEFAULT_FILTERS) -> DataFrame:
    """Files of the wanted extensions with ``skip_reason``; other extensions
    are no skips and leave first. An empty list wants nothing."""
    if extensions is not None:
        files = files.filter(F.col("ext").isin(extensions) if extensions else F.lit(False))
    return files.withColumn("skip_reason", skip_reason(files.columns, filters))


def kept(files: DataFrame) -> DataFrame:
    return files.filter("skip_reason IS NULL").drop("skip_reason")


def skip_summary(files: DataFrame) -> DataFrame:
    """(reason, n, liftable): one row for every reason that occurs."""
    found = files.filter("skip_reason IS NOT NULL").groupBy(F.col("skip_reason").alias("reason"))
    return found.agg(F.count(F.lit(1)).alias("n")).withColumn("liftable", F.col("reason").isin(*LIFTABLE))


def counted(files: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """``files`` (with ``skip_reason``) and an observation that comes with
    whatever is run on them: how many rows passed and how many each test skipped,
    without another scan."""
    seen = Observation(name) if name else Observation()
    counts = [F.count(F.when(F.col("skip_reason") == r, F.lit(1))).alias(r) for r in REASONS]
    return files.observe(seen, F.count(F.lit(1)).alias("scanned"), *counts), seen


def observed_summary(spark: SparkSession, seen: Observation) -> DataFrame:
    """What ``skip_summary`` gives, from an observation whose scan has run."""
    found = [(r, seen.get[r], r in LIFTABLE) for r in REASONS if seen.get.get(r)]
    return spark.createDataFrame(found, "reason string, n long, liftable boolean")


def in_order(summary: DataFrame) -> list[tuple[str, int]]:
    """(reason, n) in the order of the tests: at most one row a reason."""
    found = {r.reason: r.n for r in summary.collect()}
    return [(reason, found[reason]) for reason in REASONS if reason in found]


def advice(summary: list[tuple[str, int]], filters: Filters) -> str:
    """What recovery mode would change: already_on, would_help or would_not_help."""
    if filters.recovery:
        return "already_on"
    return "would_help" if any(n and r in LIFTABLE for r, n in summary) else "would_not_help"
