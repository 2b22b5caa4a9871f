"""Incremental exact dedup over a stream of files (an extension: the batch
operators rescan everything). Each micro-batch is hashed, rows of digests seen
before become duplicates, and new digests are appended to a table of their
own. A batch that is repeated after a failure finds its own rows by batch
number and gives the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfloom.functions.hashing import full_hash


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def process(batch: DataFrame, number: int, known_path: str, out_path: str) -> None:
    spark = batch.sparkSession
    rows = batch.select("path", "ext", full_hash(F.col("content")).alias("sha256")).dropna(subset=["path", "ext", "sha256"])
    known = _table(spark, known_path, "ext string, sha256 string, first_path string, batch long").filter(F.col("batch") != number)
    own = rows.groupBy("ext", "sha256").agg(F.min("path").alias("_own"))
    joined = rows.join(own, ["ext", "sha256"]).join(known.select("ext", "sha256", "first_path"), ["ext", "sha256"], "left")
    marked = joined.select("path", "ext", "sha256", F.coalesce("first_path", "_own").alias("first_path")).persist()
    try:
        new = marked.filter("path = first_path").select("ext", "sha256", "first_path").distinct()
        marked.filter("path <> first_path").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        new.join(known, ["ext", "sha256"], "left_anti").write.mode("overwrite").parquet(f"{known_path}/batch={number}")
    finally:
        marked.unpersist()


def dedup_stream(stream: DataFrame, known_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """``stream`` has path, ext, content."""
    return (
        stream.writeStream.foreachBatch(lambda df, k: process(df, k, known_path, out_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
