"""Numbers, running sums and extremes inside groups of any size.

A window by group sorts each group in one task. ``running`` splits a group over
many: rows are dealt by range of (group, order), added up inside every range in
the task that has it, and what a group has in the ranges before is added from one
row a range. That is one shuffle, whatever the groups. ``per_group``
aggregates, which combines before the shuffle, and joins the one row a group
back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfloom.runtime import materialise, ship


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's values differ from those before it; nulls are equal. False for the first."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for c in columns:
        if n > 1:
            same = pc.equal(c.slice(1), c.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            null = c.is_null().to_numpy(zero_copy_only=False)
            out[1:] |= ~(same | (null[1:] & null[:-1]))
    return out


def running(rows: DataFrame, keys: list[str], order: list[str], value: str | None, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (a long, not null; None counts rows) over the rows of the group up to
    this one, in order. Null keys form a group; rows of equal order come in any order; no rows give none. Without
    keys all rows are one group."""
    ship(rows.sparkSession)
    kept = rows.schema.fields
    inner = {f.name: f"in_{k}" for k, f in enumerate(kept)}
    extra = T.StructType([T.StructField("_sum", T.LongType()), T.StructField("_first", T.BooleanType()), T.StructField("_range", T.LongType()), T.StructField("_mark", T.StringType())])
    schema = T.StructType([*(T.StructField(inner[f.name], f.dataType) for f in kept), *extra.fields])
    arrow = to_arrow_schema(schema)
    group, amount = [inner[k] for k in keys], inner[value] if value else None

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        opened = at = None
        total = groups = 0  # of the group that is open, and how many there were
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in group]
            key = [repr(c[0].as_py()) for c in columns]
            new = _starts(columns) if columns else np.zeros(n, bool)
            new[0] = key != at
            starts, part = np.flatnonzero(new), np.cumsum(new)  # part 0 goes on from the batch before
            amounts = np.ones(n, np.int64) if amount is None else batch.column(batch.schema.get_field_index(amount)).to_numpy().astype(np.int64)
            sums = np.cumsum(amounts)
            sums -= np.concatenate([[-total], sums[starts] - amounts[starts]])[part]
            first = part + groups == 1
            opened = key if opened is None else opened
            at, total, groups = [repr(c[n - 1].as_py()) for c in columns], int(sums[-1]), groups + len(starts)
            made = [pa.array(sums), pa.array(first), pa.array(np.full(n, here)), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)
        if groups:
            mark = json.dumps({"first": opened, "last": at, "groups": groups, "tail": total})
            nothing = [pa.nulls(1, f.type) for f in list(arrow)[:-2]]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([here], pa.int64()), pa.array([mark])], schema=arrow)

    renamed = rows.select(*[F.col(f"`{a}`").alias(b) for a, b in inner.items()])
    by = [inner[c] for c in [*keys, *order]]
    dealt = renamed.repartitionByRange(*by).sortWithinPartitions(*by) if by else renamed.coalesce(1)
    out = materialise(dealt.mapInArrow(added, schema), "running")
    found = out.filter("_mark is null")
    bases = _bases(out)
    if bases:  # one row a range at most
        bases = F.broadcast(rows.sparkSession.createDataFrame(bases, "_at long, _base long"))
        found = found.join(bases, (F.col("_range") == F.col("_at")) & F.col("_first"), "left").withColumn("_sum", F.col("_sum") + F.coalesce("_base", F.lit(0)))
    return found.select(*[F.col(b).alias(a) for a, b in inner.items() if a != name], F.col("_sum").alias(name))


def _bases(out: DataFrame) -> list[tuple[int, int]]:
    """(range, what its first group has in the ranges before). One row a range reaches the driver."""
    marks = sorted((r["_range"], json.loads(r["_mark"])) for r in out.filter("_mark is not null").select("_range", "_mark").collect())
    found, last, carried = [], None, 0
    for k, m in marks:
        base = carried if m["first"] == last else 0
        if base:
            found.append((k, base))
        carried = m["tail"] + (base if m["groups"] == 1 else 0)
        last = m["last"]
    return found


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... inside each group of ``keys`` by
    ``order``. Null keys form a group; rows of equal order are numbered in any
    order; no rows give none."""
    return running(rows, keys, order, None, name)


def per_group(rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``rows`` with the aggregates of their group; null is a group. The groups
    are written, so that adaptive execution may split a hot one in the join."""
    groups = rows.groupBy(F.col(key).alias("_key")).agg(*aggregates)
    return attached(rows, key, groups)


def attached(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """``rows`` with what ``groups`` (_key, ...) has of their group."""
    groups = materialise(groups, "groups")
    return rows.join(groups, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def first_two(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first two rows of each group with ``rank``. Every task keeps two rows
    a group before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).filter("rank <= 2")
