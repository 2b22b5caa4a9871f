"""All near pairs of hashes by comparing tiles of them with numpy.

For thresholds at which banding no longer selects: with fewer than about six
bits a band nearly every pair shares one. Hashes are dealt into tiles by their
number of set bits, which differs by no more than the distance, so tiles whose
numbers are further apart are never compared. Every pair of tiles is a task's
work of its own; a tile holds about ``TILE`` hashes and is sent once to each of
its partners. The work is quadratic in the end, but a pair costs one machine
word each and is never a row unless it is near.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.runtime import ship

TILE = 4096
CELLS = 1 << 20


def set_bits(words: str) -> F.Column:
    return F.aggregate(F.col(words), F.lit(0), lambda s, w: s + F.bit_count(w))


def _words(column, width: int) -> np.ndarray:
    return np.array(column, np.int64).reshape(-1, width).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (i, j) of a matrix of near pairs: all while they are few, else
    enough to join the same rows and columns."""
    i, j = np.nonzero(near)
    if len(i) <= 2 * sum(near.shape):
        return i, j
    # the first near row of each column, and the first near column of each row, carry the rest
    keep = np.zeros(near.shape, bool)
    columns = np.flatnonzero(near.any(axis=0))
    keep[near[:, columns].argmax(axis=0), columns] = True
    # columns of one row belong together: link each row to its first column of every group that it joins
    group = near.argmax(axis=0)
    for row in np.flatnonzero(near.any(axis=1)):
        on = np.flatnonzero(near[row])
        _, first = np.unique(group[on], return_index=True)
        keep[row, on[first]] = True
    return np.nonzero(keep)


def near_pairs(reps: DataFrame, threshold: int, hashes: list[str], forest: bool = False) -> DataFrame:
    """(a, b, distance[, distance2]), a < b: the pairs of ``reps`` (rep,
    *hashes; all arrays of one length) within the threshold in every hash; with
    ``forest`` only as many of them as connect what all of them connect. No
    rows give none."""
    ship(reps.sparkSession)
    # one row a number of set bits: at most 257
    counted = reps.select("rep", *hashes, set_bits(hashes[0]).alias("_set"), F.size(hashes[0]).alias("_width"))
    sums = counted.groupBy("_set").agg(F.count(F.lit(1)).alias("n"), F.max("_width").alias("width")).collect()
    tiles = {r["_set"]: -(-r["n"] // TILE) for r in sums}
    width = max((r["width"] for r in sums), default=1)
    first, start = {}, 0
    for k in sorted(tiles):
        first[k] = start
        start += tiles[k]
    place = F.coalesce(*[F.when(F.col("_set") == k, F.lit(first[k]) + F.pmod(F.xxhash64("rep"), F.lit(n))) for k, n in tiles.items()], F.lit(0))
    packed = counted.groupBy(place.cast("long").alias("tile"), "_set").agg(F.collect_list(F.struct("rep", *hashes)).alias("members"))
    shape = ", ".join(["a string", "b string", "distance int", *(["distance2 int"] if len(hashes) > 1 else [])])
    arrow = pa.schema([("a", pa.string()), ("b", pa.string()), ("distance", pa.int32()), *([("distance2", pa.int32())] if len(hashes) > 1 else [])])

    def partners(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tile, bits = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                near = [t for k in tiles if abs(k - bits) <= threshold for t in range(first[k], first[k] + tiles[k])]
                for s in range(0, len(near), 256):
                    part = near[s : s + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([min(tile, t) for t in part], pa.int64()), pa.array([max(tile, t) for t in part], pa.int64()), pa.array([tile] * len(part), pa.int64()),
                         batch.column(2).take(pa.array([i] * len(part)))], names=["u", "v", "tile", "members"],
                    )

    def unpacked(members):
        names = np.array([m["rep"] for m in members], object)
        return names, [_words([m[h] for m in members], width) for h in hashes]

    def compared(one, two):
        (names, left), (others, right) = one, two
        step = max(1, CELLS // max(1, len(others)))
        for k in range(0, len(names), step):
            apart = [distances(a[k : k + step], b) for a, b in zip(left, right, strict=True)]
            near = np.logical_and.reduce([d <= threshold for d in apart])
            if one is two:
                near &= names[k : k + step, None] < others[None, :]
            i, j = spanning(near) if forest else np.nonzero(near)
            if len(i):
                a, b = names[k : k + step][i], others[j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b), pa.string()), pa.array(np.maximum(a, b), pa.string()), *(pa.array(d[i, j], pa.int32()) for d in apart)], schema=arrow
                )

    def run(batches):
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key, tile = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                mine = unpacked(batch.column(3)[i].as_py())
                if key[0] == key[1]:
                    yield from compared(mine, mine)
                elif key == at:
                    yield from compared(held, mine)
                else:
                    at, held = key, mine

    kind = packed.schema["members"].dataType.simpleString()
    sent = packed.select("tile", "_set", "members").mapInArrow(partners, f"u long, v long, tile long, members {kind}")
    return sent.repartition("u", "v").sortWithinPartitions("u", "v", "tile").mapInArrow(run, shape)
