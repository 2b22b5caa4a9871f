"""The survivor of every group, and why it is one.

``rank`` is 1 for the survivor, 2 for the runner-up and 3 for all others of a
group. The first two are found by tasks that keep two rows a group each; what
all rows need of their group is aggregated and joined back, so no task sorts a
group.

Defined results: ties go to the lower-cased name, then the path; a group of one
keeps its file; a null ``grp`` is a group; rows that repeat a path in a group
have the rank of the first of them; null evidence is as in ``scoring``; no rows
give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.config import CRITERIA, Priorities
from shelfloom.functions.names import RECOVERED
from shelfloom.functions.dates import is_day_level
from shelfloom.operators.ranking import first_two, per_group
from shelfloom.operators.scoring import Aggregates, date_scores, score_table, seconds, video_score_table
from shelfloom.runtime import materialise

# Margins of the explanation.
MARGIN = 0.05
NOTE_GAIN = 0.5
SPREAD = 1e-6


def gate_tier(provenance: Column, decides: Column) -> Column:
    """Recovered names last; one tier for all others if the date decides."""
    return F.when(provenance == RECOVERED, 0).when(decides, 3).otherwise(F.least(provenance, F.lit(3)))


def video_tier(provenance: Column, decides: Column) -> Column:
    return F.when(provenance == RECOVERED, 0).when(decides, 3).otherwise(provenance)


def _top(table: DataFrame) -> DataFrame:
    order = (F.desc("tier"), F.desc(F.round("total", 9)), F.lower("name"), F.col("path"))
    return first_two(table, "grp", *order)


def _top_videos(table: DataFrame) -> DataFrame:
    return first_two(table, "grp", F.desc("tier"), F.desc(F.round("total", 9)), F.col("mtime"), F.col("path"))


def _ranked(table: DataFrame, top: DataFrame) -> DataFrame:
    found = top.groupBy(F.col("grp").alias("_grp"), F.col("path").alias("_path")).agg(F.min("rank").alias("_rank"))
    same = F.col("grp").eqNullSafe(F.col("_grp")) & F.col("path").eqNullSafe(F.col("_path"))
    out = table.join(materialise(found, "ranks"), same, "left")
    return out.withColumn("rank", F.coalesce("_rank", F.lit(3))).drop("_grp", "_path", "_rank")


def judged(rows: DataFrame, priorities: Priorities = Priorities()) -> DataFrame:
    """Scores and tier of every row of image and file groups."""
    return score_table(rows, priorities).withColumn("tier", gate_tier(F.col("provenance"), F.col("date_decides")))


def judged_videos(rows: DataFrame) -> DataFrame:
    return video_score_table(rows).withColumn("tier", video_tier(F.col("provenance"), F.col("date_decides")))


def ranked(rows: DataFrame, priorities: Priorities = Priorities()) -> DataFrame:
    """Image and file groups by tier, total, lower-cased name, path."""
    table = judged(rows, priorities)
    return _ranked(table, _top(table))


def ranked_videos(rows: DataFrame) -> DataFrame:
    """Video groups by tier, total, modification time, path."""
    table = judged_videos(rows)
    return _ranked(table, _top_videos(table))


def survivors(rows: DataFrame, priorities: Priorities = Priorities()) -> DataFrame:
    """The surviving row of each image or file group."""
    return _top(judged(rows, priorities)).filter("rank = 1")


def surviving_videos(rows: DataFrame) -> DataFrame:
    return _top_videos(judged_videos(rows)).filter("rank = 1")


def ledger(ranked_rows: DataFrame) -> DataFrame:
    """Every file of every group with ``is_kept``."""
    return ranked_rows.withColumn("is_kept", F.col("rank") == 1)


def resolution_sacrifice(rows: DataFrame) -> DataFrame:
    """(grp, kept_px, best_px) where the survivor is not the sharpest; ``rows``
    are ``ranked``."""
    kept = F.max(F.when(F.col("rank") == 1, F.col("pixels"))).alias("kept_px")
    best = F.max(F.when(F.col("pixels") > 0, F.col("pixels"))).alias("best_px")
    return rows.groupBy("grp").agg(kept, best).filter("kept_px < best_px")


def explained(rows: DataFrame) -> DataFrame:
    """(grp, kept, rival, reason, criterion, margin, notes, caveat, kept_class,
    rival_class, favoured, gap_hours): one row a group of two or more, from
    ``ranked`` rows. Reasons: provenance_gate, criterion_decided, tie.
    ``caveat`` is the criterion that the note deleted_higher or
    within_threshold is about, ``favoured`` the criteria behind also_favoured
    and ``gap_hours`` the distance of the dates behind date_gap."""
    pair = F.struct("path", "tier", "total", "provenance", "pixels", "size", "importance", "ts", "ts_source", *[f"w_{c}" for c in CRITERIA])
    both = (
        rows.groupBy("grp")
        .agg(
            F.max(F.when(F.col("rank") == 1, pair)).alias("k"),
            F.max(F.when(F.col("rank") == 2, pair)).alias("r"),
            F.max(F.when(F.col("pixels") > 0, F.col("pixels"))).alias("_best_px"),
            *[(F.max(f"s_{c}") - F.min(f"s_{c}") > SPREAD).alias(f"_active_{c}") for c in CRITERIA],
        )
        .filter("r is not null")
    )
    margin = F.col("k.total") - F.col("r.total")
    gap = F.col("k.tier") > F.col("r.tier")
    gains = {c: F.when(F.col(f"_active_{c}"), F.col(f"k.w_{c}") - F.col(f"r.w_{c}")) for c in CRITERIA}
    top = F.greatest(*gains.values(), F.lit(0.0))
    criterion = F.coalesce(*[F.when((g > 1e-9) & (g >= top - 1e-9), F.lit(c)) for c, g in gains.items()])
    gate = gap & (margin <= MARGIN)
    reason = F.when(gate, F.lit("provenance_gate")).when((margin > MARGIN) & criterion.isNotNull(), F.lit("criterion_decided")).otherwise(F.lit("tie"))
    lost = F.greatest(*[-g for g in gains.values()], F.lit(0.0))
    higher = F.when(lost > NOTE_GAIN, F.coalesce(*[F.when(-g >= lost - 1e-9, F.lit(c)) for c, g in gains.items()]))
    raw = {"size": "size", "resolution": "pixels", "filename": "importance"}
    value = lambda side, c: F.coalesce(F.col(f"{side}.{raw[c]}"), F.lit(0))
    above = {
        c: F.when(~F.col(f"_active_{c}") & (value("r", c) > value("k", c)), value("r", c) / F.greatest(value("k", c), F.lit(1))) for c in raw
    }
    within = F.coalesce(*[F.when(x == F.greatest(*above.values()), F.lit(c)) for c, x in above.items()])
    dates_differ = F.coalesce(F.col("k.ts") != F.col("r.ts"), F.lit(False))
    by_day = F.coalesce(is_day_level(F.col("k.ts"), F.col("k.ts_source")), F.lit(False)) | F.coalesce(is_day_level(F.col("r.ts"), F.col("r.ts_source")), F.lit(False))
    notes = [
        F.when(higher.isNotNull(), F.lit("deleted_higher")).when(within.isNotNull(), F.lit("within_threshold")),
        F.when(dates_differ & by_day & ~F.col("_active_date"), F.lit("day_level")),
        F.when(gap, F.lit("name_class")),
        F.when(gate & (top > 1e-9), F.lit("also_favoured")),
        F.when(gate & dates_differ, F.lit("date_gap")),
        F.when(F.col("k.pixels") < F.col("_best_px"), F.lit("resolution_sacrifice")),
    ]
    return both.select(
        "grp",
        F.col("k.path").alias("kept"),
        F.col("r.path").alias("rival"),
        reason.alias("reason"),
        F.when(reason == "criterion_decided", criterion).alias("criterion"),
        margin.alias("margin"),
        F.filter(F.array(*notes), lambda n: n.isNotNull()).alias("notes"),
        F.coalesce(higher, within).alias("caveat"),
        F.col("k.provenance").alias("kept_class"),
        F.col("r.provenance").alias("rival_class"),
        F.filter(F.array(*[F.when(gate & (gains[c] > 1e-9), F.lit(c)) for c in ("date", "resolution", "size", "filename")]), lambda c: c.isNotNull()).alias("favoured"),
        F.when(gate & dates_differ, F.abs(seconds(F.col("k.ts")) - seconds(F.col("r.ts"))) / 3600.0).alias("gap_hours"),
    )


def video_reasons(rows: DataFrame) -> DataFrame:
    """(grp, path, against, decided_by, date_note) from ``ranked_videos`` rows
    of groups of two or more: every loser against the survivor, the survivor
    against the runner-up. ``decided_by`` is provenance, date, size, filename or
    tie; ``date_note`` (older, newer) only where the survivor and the runner-up
    have the same name class."""
    pick = F.struct("path", "provenance", "ts", "s_date", "s_size", "s_filename")
    place = lambda k: F.max(F.when(F.col("rank") == k, pick))
    rows = per_group(rows, "grp", place(1).alias("k"), place(2).alias("r")).filter("r is not null")
    rows = rows.withColumn("o", F.when(F.col("rank") == 1, F.col("r")).otherwise(pick))
    gains = {c: (F.col(f"k.s_{c}") - F.col(f"o.s_{c}")) * w for c, w in (("date", 3.0), ("size", 2.0), ("filename", 1.0))}
    decided = F.when(F.col("k.provenance") != F.col("o.provenance"), F.lit("provenance"))
    for c, gain in gains.items():
        decided = decided.when(gain > MARGIN, F.lit(c))
    same = (F.col("rank") == 1) & (F.col("k.provenance") == F.col("r.provenance"))
    note = F.when(same & (F.col("k.ts") < F.col("r.ts")), F.lit("older")).when(same & (F.col("k.ts") > F.col("r.ts")), F.lit("newer"))
    against = F.when(F.col("rank") == 1, F.col("r.path")).otherwise(F.col("k.path"))
    return rows.select("grp", "path", against.alias("against"), decided.otherwise(F.lit("tie")).alias("decided_by"), note.alias("date_note"))


def deletion_reasons(rows: DataFrame) -> DataFrame:
    """(grp, path, kept, reason): why each other member goes."""
    first = F.struct("path", "tier", "total", *[f"w_{c}" for c in CRITERIA])
    rows = per_group(rows, "grp", F.max(F.when(F.col("rank") == 1, first)).alias("k")).filter("rank > 1")
    gains = {c: F.col(f"k.w_{c}") - F.col(f"w_{c}") for c in CRITERIA}
    top = F.greatest(*gains.values(), F.lit(0.0))
    by = F.coalesce(*[F.when((g > 1e-9) & (g >= top - 1e-9), F.lit(f"lower_{c}")) for c, g in gains.items()], F.lit("tie_alphabetical"))
    gate = (F.col("k.tier") > F.col("tier")) & (F.col("k.total") - F.col("total") <= MARGIN)
    tie = F.col("k.total") - F.col("total") <= MARGIN
    reason = F.when(gate, F.when(F.col("tier") == 0, F.lit("recovered_name")).otherwise(F.lit("provenance_gate"))).when(tie, F.lit("tie_alphabetical")).otherwise(by)
    return rows.select("grp", "path", F.col("k.path").alias("kept"), reason.alias("reason"))


def replay_diff(rows: DataFrame, before: Priorities, after: Priorities) -> DataFrame:
    """(grp, kept_before, kept_after, changed) under two sets of priorities."""
    pick = lambda p, name: survivors(rows, p).select("grp", F.col("path").alias(name))
    both = pick(before, "kept_before").join(pick(after, "kept_after"), "grp")
    return both.withColumn("changed", F.col("kept_before") != F.col("kept_after"))


def replay_causes(rows: DataFrame, priorities: Priorities = Priorities()) -> DataFrame:
    """(grp, kept_before, kept_after, cause) of a recorded run decided again.
    ``rows`` also hold ``was_kept`` and the dates of that run, ``old_ts`` and
    ``old_source``. Causes: name_gate (the earlier survivor is of a lower tier),
    date_restored (its dates tied and now they do not), rescored; null where the
    survivor is the same. Groups without a recorded survivor have no row."""
    of = Aggregates()
    rows = of.scored(rows, {"_old_date": date_scores(F.col("old_ts"), F.col("old_source"), priorities.oldest, of)})
    new, old = F.col("rank") == 1, F.col("was_kept")
    tied = lambda c: F.min(F.round(c, 6)) == F.max(F.round(c, 6))
    both = ranked(rows, priorities).groupBy("grp").agg(
        F.max(F.when(old, F.col("path"))).alias("kept_before"),
        F.max(F.when(new, F.col("path"))).alias("kept_after"),
        (F.max(F.when(new, F.col("tier"))) > F.max(F.when(old, F.col("tier")))).alias("_gate"),
        (tied("_old_date") & ~tied("s_date")).alias("_date"),
    ).filter("kept_before is not null")
    cause = F.when(F.col("_gate"), "name_gate").when(F.col("_date"), "date_restored").otherwise("rescored")
    return both.select("grp", "kept_before", "kept_after", F.when(F.col("kept_before") != F.col("kept_after"), cause).alias("cause"))



def changed_samples(diff: DataFrame, n: int = 12) -> list[tuple[str, str, str]]:
    """(grp, kept_before, kept_after) of the first ``n`` changed groups."""
    rows = diff.filter(F.col("kept_before") != F.col("kept_after")).select("grp", "kept_before", "kept_after")
    return [tuple(r) for r in rows.orderBy("grp").limit(n).collect()]
