"""The history of runs as a table: what each run decided and did to each file.

``moves`` is Parquet under ``section=.../run=...``, append-only; ``runs`` has one
row a run, written last, under the same partitions. A run counts once its row
is there, so one that died leaves nothing that a reader sees, and writing it
again replaces what it left. Queries by section or run read those folders
alone. The text reports are renderings of this table.

Defined results: a missing table has no rows; a run without files is a run of 0
files; null sizes count as 0 bytes; rows that repeat a path are rows of their
own; columns other than the table's are left out and missing ones are null.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOVES = "grp string, original string, destination string, outcome string, is_kept boolean, reason string, size long"
RUNS = (
    "operation string, dry_run boolean, bin string, started timestamp_ntz, finished timestamp_ntz, "
    "files long, moved long, failed long, skipped long, moved_bytes long"
)
_KEYS = ", section string, run string"


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def append(
    rows: DataFrame, root: str, *, section: str, run: str, operation: str, dry_run: bool, bin_path: str, started: datetime, finished: datetime
) -> None:
    """Add a run's rows (``MOVES``), then the run itself. A run that is there already is not written again."""
    spark = rows.sparkSession
    if not runs(spark, root, section).filter(F.col("run") == run).isEmpty():
        return
    place = f"section={section}/run={run}"
    known = {c.lower() for c in rows.columns}
    fields = _schema(MOVES).fields
    kept = rows.select(*[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    kept.write.mode("overwrite").parquet(f"{root}/moves/{place}")
    written = spark.read.schema(MOVES).parquet(f"{root}/moves/{place}")
    count = lambda test: F.count(F.when(test, F.lit(1)))
    moved = F.col("outcome") == "moved"
    row = written.agg(
        F.lit(operation).alias("operation"), F.lit(dry_run).alias("dry_run"), F.lit(bin_path).alias("bin"),
        F.lit(started).cast("timestamp_ntz").alias("started"), F.lit(finished).cast("timestamp_ntz").alias("finished"),
        F.count(F.lit(1)).alias("files"), count(moved).alias("moved"), count(F.col("outcome") == "failed").alias("failed"),
        count(F.col("outcome").startswith("skipped")).alias("skipped"),
        F.coalesce(F.sum(F.when(moved, F.col("size"))), F.lit(0)).alias("moved_bytes"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/{place}")


def _read(spark: SparkSession, root: str, part: str, schema: str, section: str | None) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema + _KEYS)
    found = spark.read.schema(schema + _KEYS).parquet(f"{root}/{part}")
    return found if section is None else found.filter(F.col("section") == section)


def runs(spark: SparkSession, root: str, section: str | None = None) -> DataFrame:
    """Every finished run, one row each."""
    return _read(spark, root, "runs", RUNS, section)


def moves(spark: SparkSession, root: str, section: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """The rows of the finished runs, or of those in ``only`` (section, run, ...): only their folders are read."""
    wanted = (runs(spark, root, section) if only is None else only).select("section", "run")
    return _read(spark, root, "moves", MOVES, section).join(wanted, ["section", "run"], "left_semi")


def undo_items(spark: SparkSession, root: str, section: str, operation: str | None = None) -> DataFrame:
    """(original, reported, size, run) of what real runs of a section moved, as ``actions.located`` takes them."""
    real = runs(spark, root, section).filter(~F.col("dry_run"))
    if operation is not None:
        real = real.filter(F.col("operation") == operation)
    found = moves(spark, root, section, real).filter("outcome = 'moved'")
    return found.select("original", F.col("destination").alias("reported"), "size", "run")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last finished run of every section and operation."""
    newest = F.max_by(F.struct("run", "finished", "dry_run", "files", "moved", "moved_bytes"), F.struct("finished", "run"))
    return runs(spark, root).groupBy("section", "operation").agg(newest.alias("_last")).select("section", "operation", "_last.*")
