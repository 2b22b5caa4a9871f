"""Scores inside a group of rivals.

Inputs are columns of one row per file: grp, path, name, pixels, size,
importance, ts, ts_source. A score compares a row with aggregates of its group.
The tables below aggregate first, which combines before the shuffle, and join
one row a group back, so a group of any size is no task of its own. The single
functions take their aggregates from a window unless told otherwise.

Defined results: null values are unknown: no size or resolution scores 0 beside
known ones, no date 3, no importance 0; groups of one, and groups whose values
are about equal, tie at 5; a null ``grp`` is a group; rows that repeat a path
are scored alike; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.config import CRITERIA, Priorities
from shelfloom.functions.dates import is_day_level
from shelfloom.operators.ranking import per_group
from shelfloom.runtime import materialise

# Fixed values of the scoring rules.
GATE_RATIO = 1.05
DATE_NOISE_SECONDS = 60
BOOST_ABOVE, BOOST_CAP = 2.0, 3.0
TIE = 5.0
UNKNOWN_DATE = 3.0


def group() -> Window:
    return Window.partitionBy("grp")


def windowed(aggregate: Column) -> Column:
    return aggregate.over(group())


class Aggregates:
    """Collects the aggregates that scores ask for, and joins them to rows."""

    def __init__(self):
        self.asked: list[Column] = []

    def __call__(self, aggregate: Column) -> Column:
        name = f"_a{len(self.asked)}"
        self.asked.append(aggregate.alias(name))
        return F.col(name)

    def scored(self, rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
        # read twice, for the groups and for the scores, and what a name tells is dear: so it is written once
        rows = materialise(rows, "evidence")
        return per_group(rows, "grp", *self.asked).withColumns(scores).drop(*[f"_a{k}" for k in range(len(self.asked))])


def gate_passes(low: Column, high: Column) -> Column:
    """Whether two values differ enough to count."""
    return F.when(low.isNull() | high.isNull(), F.lit(False)).when((low <= 0) | (high <= 0), low != high).otherwise(high / low >= GATE_RATIO)


def ratio_scores(value: Column, of=windowed) -> Column:
    """0 to 10 on a log scale between the group's least and greatest positive
    value; 5 for all if fewer than two are known or they are about equal."""
    good = F.when(value > 0, value.cast("double"))
    low, high, n = of(F.min(good)), of(F.max(good)), of(F.count(good))
    scaled = 10.0 * F.ln(good / low) / F.ln(high / low)
    open_ = (n >= 2) & gate_passes(low, high)
    return F.when(~F.coalesce(open_, F.lit(False)), F.lit(TIE)).otherwise(F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.0), scaled)), F.lit(0.0)))


def filename_scores(importance: Column, of=windowed) -> Column:
    low, high = of(F.min(importance)), of(F.max(importance))
    scaled = F.least(F.lit(10.0), F.greatest(F.lit(0.0), importance * 10.0 / 9.0))
    return F.when(low == high, F.lit(TIE)).otherwise(F.coalesce(scaled, F.lit(0.0)))


def seconds(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def _date_state(ts: Column, source: Column, of) -> tuple[Column, Column, Column, Column, Column]:
    """(known dates, seconds compared, least, greatest, undecided)."""
    exact, day = seconds(ts), seconds(F.date_trunc("day", ts).cast("timestamp_ntz"))
    known, first, last = of(F.count(ts)), of(F.min(exact)), of(F.max(exact))
    # a date without a time of day is only compared with days
    by_day = of(F.max(F.coalesce(is_day_level(ts, source), F.lit(False)).cast("int"))) == 1
    used = F.when(by_day, day).otherwise(exact)
    low, high = F.when(by_day, of(F.min(day))).otherwise(first), F.when(by_day, of(F.max(day))).otherwise(last)
    return known, used, low, high, (last - first < DATE_NOISE_SECONDS) | (low == high)


def date_scores(ts: Column, source: Column, oldest: bool = True, of=windowed) -> Column:
    known, used, low, high, undecided = _date_state(ts, source, of)
    share = 10.0 * ((high - used) if oldest else (used - low)) / F.nullif(high - low, F.lit(0.0))
    return (
        F.when(known == 0, F.lit(TIE))
        .when(known == 1, F.when(ts.isNotNull(), F.lit(10.0)).otherwise(F.lit(UNKNOWN_DATE)))
        .when(undecided, F.lit(TIE))
        .otherwise(F.coalesce(share, F.lit(UNKNOWN_DATE)))
    )


def date_span_seconds(ts: Column, source: Column, of=windowed) -> Column:
    known, _, low, high, undecided = _date_state(ts, source, of)
    return F.when((known >= 2) & ~F.coalesce(undecided, F.lit(True)), high - low)


def date_decides(ts: Column, source: Column, priorities: Priorities, of=windowed) -> Column:
    return F.coalesce(date_span_seconds(ts, source, of) >= priorities.gate_gap_seconds, F.lit(False))


def resolution_boost(pixels: Column, of=windowed) -> Column:
    good = F.when(pixels > 0, pixels.cast("double"))
    low, high, n = of(F.min(good)), of(F.max(good)), of(F.count(good))
    ratio = high / low
    boost = F.least(F.lit(BOOST_CAP), 1.0 + 0.5 * F.log2(ratio))
    return F.when((n >= 2) & (ratio > BOOST_ABOVE), boost).otherwise(F.lit(1.0))


def score_table(rows: DataFrame, priorities: Priorities = Priorities()) -> DataFrame:
    """``rows`` with the four scores, their weighted forms, ``boost``,
    ``total`` and ``date_decides``."""
    of = Aggregates()
    rows = of.scored(
        rows,
        {
            "s_resolution": ratio_scores(F.col("pixels"), of),
            "s_size": ratio_scores(F.col("size"), of),
            "s_date": date_scores(F.col("ts"), F.col("ts_source"), priorities.oldest, of),
            "s_filename": filename_scores(F.col("importance"), of),
            "boost": resolution_boost(F.col("pixels"), of),
            "date_decides": date_decides(F.col("ts"), F.col("ts_source"), priorities, of),
        },
    )
    weights = priorities.weights
    weighted = {}
    for c in CRITERIA:
        w = F.col(f"s_{c}") * float(weights[c]) if priorities.enabled.get(c, True) else F.lit(0.0)
        weighted[f"w_{c}"] = w * F.col("boost") if c == "resolution" else w
    rows = rows.withColumns(weighted)
    return rows.withColumn("total", sum((F.col(f"w_{c}") for c in CRITERIA[1:]), F.col("w_resolution")))


def video_score_table(rows: DataFrame) -> DataFrame:
    """Video rivals: date 3, size 2, name 1 by the class's importance."""
    from shelfloom.functions.names import VIDEO_IMPORTANCE

    graded = F.coalesce(*[F.when(F.col("provenance") == k, F.lit(v)) for k, v in VIDEO_IMPORTANCE.items()])
    of = Aggregates()
    rows = of.scored(
        rows,
        {
            "s_size": ratio_scores(F.col("size"), of),
            "s_date": date_scores(F.col("ts"), F.col("ts_source"), of=of),
            "s_filename": ratio_scores(graded, of),
            "date_decides": date_decides(F.col("ts"), F.col("ts_source"), Priorities(), of),
        },
    )
    return rows.withColumn("total", 3.0 * F.col("s_date") + 2.0 * F.col("s_size") + F.col("s_filename"))


def size_score(mb: Column) -> Column:
    """Absolute score of a size."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.1), mb / 0.5))


def resolution_score(pixels: Column) -> Column:
    """Absolute score of a pixel count."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.1), pixels / 1e6))
