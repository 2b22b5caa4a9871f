"""Near pairs of hashes by probing few long bands.

Two hashes within ``threshold`` bits differ, in one of ``m`` bands at least, by
``threshold // m`` bits or fewer. So each hash is sent under the values of its
bands and under all that differ from these by up to half as many bits: two that
are that near in a band meet under a value between them. Long bands keep apart
what short ones do not, at the price of more keys a hash; ``plan`` weighs keys,
comparisons and a comparison of everything (``tiles``) against each other.

Hashes that meet under a key are compared with numpy where they meet. A key that
more than ``HOT`` share is not compared there: its hashes are dealt into parts of
about that size, and every two parts are a piece of work of their own.

Defined results: as in ``similar``; a pair that meets under several keys comes
once; with ``forest`` a key hands on only links that connect what all connect.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.operators.tiles import CELLS, distances, spanning
from shelfloom.runtime import materialise, ship

HOT = 4096
#: What a key, and a comparison in numpy, take, in microseconds; measured on one core.
KEY_COST, CELL_COST = 4.0, 0.003
#: Keys a hash, at most: what it is worth to be sent under.
KEYS = 1024


@dataclass(frozen=True)
class Bands:
    edges: tuple[tuple[int, int], ...]  # (start, length)
    flips: int

    @property
    def keys(self) -> int:
        return sum(_ball(n, self.flips) for _, n in self.edges)

    @property
    def candidates(self) -> float:
        """Comparisons for each pair of random hashes."""
        return sum(_ball(n, self.flips) ** 2 / 2**n for _, n in self.edges)


def _ball(bits: int, flips: int) -> int:
    return sum(comb(bits, k) for k in range(flips + 1))


def _bands(bits: int, m: int, threshold: int) -> Bands:
    edges = [round(k * bits / m) for k in range(m + 1)]
    return Bands(tuple((a, b - a) for a, b in zip(edges, edges[1:], strict=False)), -(-(threshold // m) // 2))


def plan(n: int, bits: int, threshold: int) -> Bands | None:
    """The cheapest bands for ``n`` hashes, or None where comparing everything is cheaper."""
    best, least = None, n * n / 2 * CELL_COST
    for m in range(1, min(threshold + 1, bits) + 1):
        found = _bands(bits, m, threshold)
        if found.keys > KEYS or max(length for _, length in found.edges) > 48:
            continue
        cost = n * found.keys * KEY_COST + n * n / 2 * found.candidates * CELL_COST
        if cost < least:
            best, least = found, cost
    return best


def _keys(text: Column, bands: Bands) -> Column:
    """The keys of a hash, given as text of 0 and 1: the number of the band above the band's value."""
    out = []
    for k, (start, length) in enumerate(bands.edges):
        value = F.conv(F.substring(text, start + 1, length), 2, 10).cast("long")
        masks = [sum(1 << b for b in bits) for r in range(bands.flips + 1) for bits in itertools.combinations(range(length), r)]
        out.append(_under(value, masks, k << 48))
    return F.flatten(F.array(*out))


def _under(value: Column, masks: list[int], band: int) -> Column:
    return F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: value.bitwiseXOR(x) + F.lit(band).cast("long"))


def near_pairs(reps: DataFrame, text: Column, threshold: int, hashes: list[str], bands: Bands, forest: bool = False, hot: int = HOT) -> DataFrame:
    """(a, b, distance[, distance2]), a < b: as ``tiles.near_pairs``. ``text`` is the first hash as text of 0 and 1."""
    ship(reps.sparkSession)
    apart = ["distance", "distance2"][: len(hashes)]
    shape = ", ".join(["a string", "b string", *(f"{c} int" for c in apart)])
    arrow = pa.schema([("a", pa.string()), ("b", pa.string()), *((c, pa.int32()) for c in apart), ("hot", pa.int64()), ("n", pa.int64())])

    def unpacked(columns) -> tuple:
        names = np.array(columns[0].to_pylist(), object)
        words = [np.array(c.to_pylist(), np.int64).view(np.uint64).reshape(len(names), -1) for c in columns[1:]]
        return names, words

    def compared(one: tuple, two: tuple):
        (names, left), (others, right) = one, two
        step = max(1, CELLS // max(1, len(others)))
        for k in range(0, len(names), step):
            far = [distances(a[k : k + step], b) for a, b in zip(left, right, strict=True)]
            near = np.logical_and.reduce([d <= threshold for d in far])
            if one is two:
                near &= names[k : k + step, None] < others[None, :]
            i, j = spanning(near) if forest else np.nonzero(near)
            if len(i):
                a, b = names[k : k + step][i], others[j]
                found = [pa.array(np.minimum(a, b), pa.string()), pa.array(np.maximum(a, b), pa.string()), *(pa.array(d[i, j], pa.int32()) for d in far)]
                yield pa.RecordBatch.from_arrays([*found, pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())], schema=arrow)

    def meet(batches):
        """Rows (key, p, q, part, rep, hashes) in order of key, p, q: each run is compared, or told to be hot."""
        held, at, size = [], None, 0

        def over():
            if at is None or size < 2:
                return
            if size > hot and at[1] == at[2] == -1:
                nothing = [pa.nulls(1, f.type) for f in list(arrow)[:-2]]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([at[0]], pa.int64()), pa.array([size], pa.int64())], schema=arrow)
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            parts = rows.column("part").to_numpy()
            one = unpacked([rows.column(c) for c in ("rep", *hashes)])
            if at[1] == at[2]:
                yield from compared(one, one)
            else:
                p, q = np.flatnonzero(parts == at[1]), np.flatnonzero(parts == at[2])
                yield from compared(*[(one[0][k], [w[k] for w in one[1]]) for k in (p, q)])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(3)]
            new = np.flatnonzero(np.logical_or.reduce([np.concatenate([[True], k[1:] != k[:-1]]) for k in keys]))
            for a, b in zip(new, [*new[1:], batch.num_rows], strict=True):
                here = tuple(int(k[a]) for k in keys)
                if here != at:
                    yield from over()
                    held, at, size = [], here, 0
                size += b - a
                if size <= hot or at[1] != -1:
                    held.append(batch.slice(a, b - a))
        yield from over()

    order = ["key", "p", "q"]
    columns = ["rep", *hashes]
    keyed = reps.select(*columns, F.explode(_keys(text, bands)).alias("key"))
    minus = F.lit(-1).cast("long")
    first = keyed.select("key", minus.alias("p"), minus.alias("q"), minus.alias("part"), *columns)
    run = lambda rows: rows.repartition("key", "p", "q").sortWithinPartitions(*order).mapInArrow(meet, f"{shape}, hot long, n long")
    found = materialise(run(first), "probed")
    pairs = found.filter("a is not null").select("a", "b", *apart)
    crowded = found.filter("hot is not null").select(F.col("hot").alias("key"), F.ceil(F.col("n") / hot).cast("long").alias("parts"))
    if not crowded.isEmpty():
        placed = keyed.join(materialise(crowded, "crowded"), "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        placed = placed.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", *columns)
        pairs = pairs.unionByName(run(placed).select("a", "b", *apart))
    return pairs.distinct()

