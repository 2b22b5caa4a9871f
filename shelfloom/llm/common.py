"""Helpers shared by the training-data operators.

Text work that Spark's own functions cannot express runs through
``add_columns``: Arrow batches in, the same batches plus new columns out, in
slices of a few hundred rows, so a task holds one Arrow batch and the Python
objects of one slice, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfloom.runtime import materialise, shared_dir, ship, table  # noqa: F401  for the operators

SLICE_ROWS = 256


def add_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    factory: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """``df`` with the ``outputs`` appended; they replace columns of the same
    names. ``factory()`` runs once a task and returns a function from the input
    values of one row (``None`` for null) to the tuple of output values."""
    ship(df.sparkSession)
    arrow_out = to_arrow_schema(outputs)
    made_names = {n.lower() for n in outputs.names}
    kept = [k for k, c in enumerate(df.columns) if c.lower() not in made_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs]
                rows = [fn(*values) for values in zip(*columns, strict=True)]
                made = [
                    pa.array([row[i] for row in rows], type=field.type)
                    for i, field in enumerate(arrow_out)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), *made], names=[*(part.schema.names[k] for k in kept), *arrow_out.names]
                )

    schema = T.StructType([*(df.schema.fields[k] for k in kept), *outputs.fields])
    return df.mapInArrow(run, schema)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that further
    columns of the table can never clash: ``renamed(df, _id="doc_id")``."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def fenced(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns under names of their own, and the new name of
    each, for operators that hand on whole rows: no inner name can clash.
    ``toDF(*df.columns)`` gives the names back."""
    names = {c: f"in_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unit_hash(*columns) -> F.Column:
    """A value in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def class_sizes(df: DataFrame, label: str, hashed: F.Column) -> dict:
    """label -> (rows, about how many different hashes). One aggregated row a
    label reaches the driver."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(hashed).alias("d")).collect()
    return {r[label]: (r["n"], max(1, r["d"])) for r in rows if r[label] is not None}


def thinned(df: DataFrame, label: str, hashed: F.Column, sizes: dict, per_class: int) -> DataFrame:
    """The rows whose hash is under their class's rate: somewhat more than
    ``per_class`` different hashes of each class. Rows of equal hash stay or go
    together, however many they are."""
    keep = F.lit(False)
    for value, (_, distinct) in sizes.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (hashed < F.lit(1.2 * per_class / distinct + 1e-9)))
    return df.filter(keep)


def capped(df: DataFrame, label: str, order: list[str], sizes: dict, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, the first by ``order``. Every
    task hands on its own first rows only."""
    parts = [df.filter(F.col(label) == F.lit(v)).orderBy(*order).limit(per_class) for v in sorted(sizes, key=str)]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def text_digest(column: str) -> F.Column:
    """SHA-256 of a text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


#: Bits of a map of keys: 4 MiB, whatever the number of keys.
MAP_BITS = 1 << 25


def key_maps(*keys: DataFrame) -> DataFrame:
    """(_piece, _map0, _map1, ...): of each table of 64-bit hashes (_hash) the bits of ``MAP_BITS`` that they set, in pieces of
    4 KiB. Small enough to send to every task, whatever the tables: ``MAP_BITS / 8`` bytes each."""
    out = None
    for k, rows in enumerate(keys):
        at = F.pmod("_hash", F.lit(MAP_BITS)) + 1
        pieces = rows.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_piece"))
        made = pieces.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias(f"_map{k}"))
        out = made if out is None else out.join(made, "_piece", "full")
    return materialise(out, "key-maps")


def looked_up(rows: DataFrame, maps: DataFrame, hashes: dict[str, tuple[F.Column, int]]) -> DataFrame:
    """``rows`` with a boolean for each name of ``hashes``: whether map number ``n`` has the bit of that hash, which is so for
    every key that is in it and for few others. The rows stay where they are."""
    for name, (value, n) in hashes.items():
        piece, byte = F.col(f"_piece_{name}"), F.col(f"_byte_{name}")
        side = F.broadcast(maps.select(F.col("_piece").alias(f"_piece_{name}"), F.col(f"_map{n}").alias(f"_byte_{name}")))
        at = F.pmod(value, F.lit(MAP_BITS)) + 1
        place = F.bitmap_bit_position(at)
        met = rows.join(side, F.bitmap_bucket_number(at) == piece, "left")
        bits = F.conv(F.hex(F.substring(byte, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = bits.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (place % 8).cast("int") + 1)) != 0
        rows = met.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias(name))
    return rows


def one_row_each(docs: DataFrame, decided: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. ``decided`` has
    (_id, _digest, _stays) of every row. Of rows that repeat both id and text
    of one that stays, one stays; null ids are ids like any other here.

    Texts stay where they are read. Which rows go is told by a map of the keys
    that go, and which of those it takes for such by mistake by a second map, made
    from the keys of all rows, so that only rows that both maps know, and those
    that repeat, meet the keys themselves in a join."""
    hashed = F.xxhash64("_id", "_digest").alias("_hash")
    marks = decided.groupBy("_id", "_digest").agg(F.max("_stays").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    marks = materialise(marks.withColumn("_hash", hashed), "marks")
    go, again = marks.filter("not _stays"), marks.filter("_stays and _rows > 1")
    first = key_maps(go.select("_hash"))
    taken = looked_up(marks.filter("_stays"), first, {"_hit": (F.col("_hash"), 0)}).filter("_hit").select("_hash")
    second = key_maps(taken.union(again.select("_hash")))

    rows, names = fenced(docs)
    key = rows.withColumn("_digest", text_digest(names[text_col])).withColumn("_key", F.xxhash64(names[id_col], "_digest"))
    told = looked_up(looked_up(key, first, {"_going": (F.col("_key"), 0)}), second, {"_unsure": (F.col("_key"), 0)})
    out = told.filter("not _unsure and not _going").select(*names.values())
    exact = marks.filter("not _stays or _rows > 1").select(F.col("_id").alias("_mid"), F.col("_digest").alias("_md"), "_stays")
    # merged at every size, so that the plan of a small table is that of a large one
    met = told.filter("_unsure").join(exact.hint("merge"), F.col(names[id_col]).eqNullSafe(F.col("_mid")) & (F.col("_digest") == F.col("_md")), "left")
    out = out.union(met.filter("_stays is null").select(*names.values()))
    if not again.isEmpty():
        # equal rows become one inside every task before they are shuffled
        out = out.union(met.filter("_stays").dropDuplicates([names[id_col], "_digest"]).select(*names.values()))
    return out.toDF(*docs.columns)
