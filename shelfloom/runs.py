"""A whole run on files, and its undoing: destinations, journal, ledger, index.

``carry_out`` takes decided groups and moves what does not stay; ``undo`` copies
back what earlier runs of a section have moved. Both keep their state below one
folder on shared storage: ``journal`` (what is under way), ``ledger`` (what was
done) and ``index`` (what lies in the bin). Either may be called again with the
same run after a crash: what the journal has is not done twice, and the ledger
gets the run once.

Defined results: a dry run moves nothing and has outcome ``dry_run`` for every
file; groups without a kept file have no survivor to look for, as files that are
corrupt or small; a run without files is a run of 0 files.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom import journal, ledger
from shelfloom.actions import cleaned_folder, destinations
from shelfloom.bin_index import BinIndex
from shelfloom.functions.names import base_name
from shelfloom.runtime import materialise, ship
from shelfloom.sources import library


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def index_of(spark: SparkSession, state: str) -> BinIndex:
    """The index of the bin below ``state``; the table's name comes from the folder's."""
    import hashlib

    return BinIndex(spark, f"{state}/index", f"bin_{hashlib.sha256(state.encode()).hexdigest()[:16]}")


def _with_folder(files: DataFrame, home: str | None) -> DataFrame:
    """``files`` (path, ...) with the ``folder`` of each in the bin."""
    ship(files.sparkSession)

    def run(frames) -> Iterator:
        for frame in frames:
            yield frame.assign(folder=[cleaned_folder(p, home) for p in frame["path"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{fields}, folder string")


def planned(decided: DataFrame, bin_root: str, sub: str, home: str | None = None) -> DataFrame:
    """(grp, original, destination, size, survivor, reason) of every file of ``decided`` (grp, path, is_kept[, size, reason]) that
    goes. Names that the bin's folders have already are not used again."""
    spark = decided.sparkSession
    for name, kind in (("size", "long"), ("reason", "string")):
        if name not in decided.columns:
            decided = decided.withColumn(name, F.lit(None).cast(kind))
    kept = decided.filter("is_kept").select(F.col("grp").alias("_grp"), F.col("path").alias("survivor"))
    goes = decided.filter("not is_kept").select("grp", "path", F.col("size").cast("long").alias("size"), "reason", base_name(F.col("path")).alias("name"))
    goes = materialise(_with_folder(goes, home), "goes")
    top = f"{bin_root}/{sub}"
    there = library.read(spark, [top], numPartitions="8").select("path", "name")
    taken = there.select(F.expr(f"substring(path, {len(top) + 2}, length(path) - {len(top) + 2} - length(name))").alias("folder"), "name")
    placed = destinations(goes, bin_root, sub, taken)
    placed = placed.join(materialise(kept, "survivors"), F.col("grp") == F.col("_grp"), "left")
    return placed.select("grp", F.col("path").alias("original"), "destination", "size", "survivor", "reason")


def carry_out(
    decided: DataFrame, state: str, *, run: str, section: str, operation: str, bin_root: str, dry_run: bool = True, force: bool = False, home: str | None = None
) -> DataFrame:
    """Do a run on decided groups and return its rows of the ledger."""
    spark, began = decided.sparkSession, _now()
    place = Path(f"{journal._local(state)}/journal") / run
    if dry_run or not (place / "intent").exists():
        plan = materialise(planned(decided, bin_root, operation, home), "plan")
    else:  # a run that died has its plan, whatever its files are by now
        plan = journal.intents(spark, str(place)).select(F.lit(None).cast("string").alias("grp"), "original", "destination", "size", "survivor", F.lit(None).cast("string").alias("reason"))
    if dry_run:
        rows = plan.withColumn("outcome", F.lit("dry_run"))
    else:
        done = journal.resume(spark, journal.begin(plan, f"{state}/journal", run), force=force)
        told = plan.select(F.col("original").alias("_original"), "grp", "reason")
        rows = done.join(told, F.col("original") == F.col("_original"), "left").select("grp", "original", "destination", "outcome", "reason", "size")
    rows = rows.withColumn("is_kept", F.lit(False))
    known = ledger.runs(spark, f"{state}/ledger", section).filter(F.col("run") == run).isEmpty()
    if known and not dry_run:
        moved = rows.filter("outcome = 'moved'").select(F.col("destination").alias("path"), base_name(F.col("destination")).alias("name"), "size")
        index_of(spark, state).add(moved)
    ledger.append(rows, f"{state}/ledger", section=section, run=run, operation=operation, dry_run=dry_run, bin_path=bin_root, started=began, finished=_now())
    return ledger.moves(spark, f"{state}/ledger", section).filter(F.col("run") == run)


def undo(spark: SparkSession, state: str, *, run: str, section: str, operation: str | None = None, dry_run: bool = True) -> DataFrame:
    """Copy back what real runs of a section have moved, and return the run's rows: outcome restored, already_there, missing,
    failed, or ``would_restore`` for a dry run. What lies in the bin stays there."""
    began = _now()
    items = ledger.undo_items(spark, f"{state}/ledger", section, operation).groupBy("original").agg(F.max_by(F.struct("reported", "size"), "run").alias("_i"))
    found = index_of(spark, state).located(items.select("original", "_i.reported", "_i.size")).select("original", "actual", "size", "status")
    found = materialise(found, "located")
    if dry_run:
        outcome = F.when(F.col("status") == "missing", "missing").otherwise("would_restore")
        rows = found.select("original", F.col("actual").alias("destination"), outcome.alias("outcome"), "size")
    else:
        plan = found.select("original", F.col("actual").alias("destination"), "size")
        done = journal.resume(spark, journal.begin(plan, f"{state}/journal", run, kind="copy"))
        rows = done.select("original", "destination", "outcome", "size")
    ledger.append(rows, f"{state}/ledger", section=section, run=run, operation="restore", dry_run=dry_run, bin_path="", started=began, finished=_now())
    return ledger.moves(spark, f"{state}/ledger", section).filter(F.col("run") == run)
