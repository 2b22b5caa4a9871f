"""Undersized and corrupt media.

Defined results: unknown dimensions are not small; rows that repeat a path count
each; no rows give counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_small(width: Column, height: Column, min_width: int = 300, min_height: int = 300) -> Column:
    """Unknown dimensions are not small."""
    return F.coalesce((width < min_width) | (height < min_height), F.lit(False))


def small_reason(width: Column, height: Column, min_width: int = 300, min_height: int = 300) -> Column:
    return F.when((width < min_width) & (height < min_height), "both").when(width < min_width, "width").when(height < min_height, "height")


def small_files(files: DataFrame, min_width: int = 300, min_height: int = 300) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return files.filter(is_small(w, h, min_width, min_height)).withColumn("reason", small_reason(w, h, min_width, min_height))


def small_stats(small: DataFrame) -> DataFrame:
    """(n, n_both, n_width, n_height, bytes)."""
    count = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}")
    return small.agg(F.count(F.lit(1)).alias("n"), count("both"), count("width"), count("height"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def parse_dimensions(text: str) -> tuple[int, int] | None:
    """Typed dimensions: ``800x600``, ``width=800 height=600`` in any order,
    one number for a square; the first two of more. 1 to 10000 each."""
    import re

    named = {k[0]: int(v) for k, v in re.findall(r"(width|height|w|h)\s*[=:]\s*(\d+)", (text or "").lower())}
    numbers = [int(n) for n in re.findall(r"\d+", text or "")]
    if not numbers:
        return None
    w, h = (named["w"], named["h"]) if len(named) == 2 else (numbers[0], numbers[1] if len(numbers) > 1 else numbers[0])
    return (w, h) if 1 <= w <= 10000 and 1 <= h <= 10000 else None


def corrupt(media: DataFrame) -> DataFrame:
    return media.filter(F.col("verdict") == "corrupt")


def examples(rows: DataFrame, n: int = 5) -> list[str]:
    """The first ``n`` paths, for a message."""
    return [r.path for r in rows.select("path").orderBy("path").limit(n).collect()]
