"""Exact duplicates: cheap keys narrow the candidates, a digest decides.

Content is hashed where it is read: every operator first replaces ``content``
by its digest (``hashed``), so what is joined, grouped and shuffled are paths,
sizes and digests. Files on disk need no ``content`` at all: ``hash_candidates``
reads those that share extension and size, block by block, by their path.

Defined results: a file without content (null) has a null digest and is no
duplicate; null keys never match; empty files are duplicates of each other; a
path that comes twice counts twice; no files give no groups and totals of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.hashing import SAMPLE, full_hash, sample_hash, sampled_bytes
from shelfloom.runtime import materialise


def hashed(files: DataFrame, sample: int | None = None) -> DataFrame:
    """``files`` with ``sha256`` (and ``sample``) in place of ``content``; as
    they are if they have a digest already."""
    if "content" not in files.columns:
        return files
    if sample is not None:
        files = files.withColumn("sample", sample_hash(F.col("content"), F.col("size"), sample))
    return files.withColumn("sha256", full_hash(F.col("content"))).drop("content")


def shared(files: DataFrame, keys: list[str]) -> DataFrame:
    """The files whose key occurs more than once (null keys do not). The keys
    are written, so that adaptive execution may split a hot one in the join."""
    many = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return files.join(materialise(many, "keys"), keys, "left_semi")


def size_candidates(files: DataFrame) -> DataFrame:
    return shared(files.drop("content"), ["ext", "size"])


def hash_candidates(files: DataFrame) -> DataFrame:
    """Files on disk (path, ext, size, ...) that share extension and size, with
    the digest of their content."""
    from shelfloom.sources.files import streamed_hashes

    found = materialise(size_candidates(files), "size-candidates")
    return found.join(streamed_hashes(found), "path")


def sample_candidates(files: DataFrame, n: int = SAMPLE) -> DataFrame:
    """After the size step, those whose head and tail agree as well, with
    ``sha256``. A sample can only exclude, never decide."""
    return shared(hashed(files, n), ["ext", "size", "sample"])


def sample_stats(files: DataFrame, n: int = SAMPLE) -> DataFrame:
    """One row: files and bytes at each step."""
    one = F.lit(1)
    rows = files.select("ext", "size", sample_hash(F.col("content"), F.col("size"), n).alias("sample"))
    same_sample = rows.groupBy("ext", "size", "sample").agg(F.count(one).alias("n"))
    last = (F.col("n") > 1) & F.col("sample").isNotNull()
    same_size = same_sample.groupBy("ext", "size").agg(F.sum("n").alias("n"), F.sum(F.when(last, F.col("n")).otherwise(0)).alias("m"))
    sized = (F.col("n") > 1) & F.col("ext").isNotNull() & F.col("size").isNotNull()
    total = lambda value: F.coalesce(F.sum(F.when(sized, value)), F.lit(0)).cast("long")
    return same_size.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scanned"),
        total(F.col("n")).alias("size_candidates"),
        total(F.col("n") * F.col("size")).alias("naive_bytes"),
        total(F.col("n") * sampled_bytes(F.col("size"), n)).alias("sampled_bytes"),
        total(F.col("m")).alias("sample_candidates"),
        total(F.col("m") * F.col("size")).alias("full_bytes"),
    )


def duplicate_rows(files: DataFrame, by_extension: bool = True) -> DataFrame:
    """Files (without content) that have a duplicate, with ``sha256``: images
    group across extensions, other kinds do not. One row a member."""
    return shared(materialise(hashed(files), "digests"), ["ext", "sha256"] if by_extension else ["sha256"])


def duplicate_groups(files: DataFrame, by_extension: bool = True) -> DataFrame:
    """([ext,] sha256, n, first) of every group: its size and first path. The
    members are rows of ``duplicate_rows``; no list of them is ever made."""
    keys = ["ext", "sha256"] if by_extension else ["sha256"]
    rows = hashed(files).dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).filter("n > 1")


def totals(groups: DataFrame) -> DataFrame:
    """(groups, files, deletable) of any groups with their size ``n``."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deletable"),
    )
