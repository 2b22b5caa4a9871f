"""An index of the recycle bin that runs keep up to date, bucketed by name.

Each file of the bin is there under its name and under its name without a
collision number. The table is bucketed and sorted by that key, so what is looked
up in it is dealt to the buckets, and the bin itself is read where it lies: its
side of a join has no exchange, however large it is. ``add`` appends what a run has
moved, ``drop_gone`` writes the index anew without what is no longer in the bin.

Defined results: as in ``actions.located``; files that were added twice count
once; an index without files finds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.actions import _by_key, _by_size, _located, bin_keys

BUCKETS = 64


class BinIndex:
    """The index at ``location``, under the name of a table of the session. The number of buckets must be that which it was made with."""

    def __init__(self, spark: SparkSession, location: str, name: str = "bin_index", buckets: int = BUCKETS):
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"not a name for a table: {name}")
        self.spark, self.name, self.buckets, self.location = spark, name, buckets, location
        # lets a table that is dealt by one column meet rows by that column and more
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (_path STRING, _name STRING, _size BIGINT, _key STRING) "
            f"USING parquet CLUSTERED BY (_key) SORTED BY (_key) INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )

    def _written(self, keys: DataFrame, mode: str) -> None:
        # one file a bucket and run
        dealt = keys.select("_path", "_name", "_size", "_key").repartition(self.buckets, "_key")
        dealt.write.insertInto(self.name, overwrite=mode == "overwrite")
        self.spark.catalog.refreshTable(self.name)

    def add(self, moved: DataFrame) -> None:
        """Add files of the bin (path, name, size)."""
        self._written(bin_keys(moved.select("path", "name", "size")), "append")

    def drop_gone(self, in_bin: DataFrame) -> None:
        """Keep only what is among ``in_bin`` (path, name, size), with its present size."""
        from shelfloom.runtime import materialise

        self._written(materialise(bin_keys(in_bin.select("path", "name", "size")), "bin-index"), "overwrite")

    def keys(self) -> DataFrame:
        """(_key, _path, _name, _size), each file once under every key."""
        return self.spark.table(self.name).groupBy("_key", "_path", "_name").agg(F.max("_size").alias("_size"))

    def located(self, removed: DataFrame) -> DataFrame:
        """``actions.located`` on the index."""
        keys = self.keys()
        there = keys.groupBy(F.col("_key").alias("_there_key"), F.col("_path").alias("_there")).agg(F.max("_size").alias("_there_size")).drop("_there_size")
        # a place is looked up under its file's name, which deals it like the index
        at = [F.substring_index("reported", "/", -1) == F.col("_there_key"), F.col("reported") == F.col("_there")]
        return _located(removed, _by_key(keys), _by_size(keys), there, at)
