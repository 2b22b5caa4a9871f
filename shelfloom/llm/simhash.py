"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are cut into four quarters; a *cell* holds the fingerprints with
the same four bit counts. Two fingerprints within ``radius`` bits have bit
counts whose differences, added over the quarters, are at most ``radius`` (one
differing bit changes one quarter's count by one), so tile pairs of cells
further apart are skipped and none within the radius is lost. Cells are split
into tiles of about ``TILE`` fingerprints. Every pair of tiles that may hold a
link is a piece of work of its own, whatever cell it comes from: both tiles are
sent under the pair's key and compared with numpy exclusive-or and bit counts,
block by block.

Only distinct fingerprints are compared. Each comparison hands on a forest, not
all pairs of a dense group, and the forests become components in ``graph``.

A wide radius skips few pairs of cells, and many small cells would be sent to one
another; ``grain`` then makes cells of that many bit counts a quarter, whose least
difference decides. Who verifies the links takes ``nearest`` ones of a dense group
in place of the forest, as a forest holds only while all its links do. Of these a pair of
tiles hands on one for each fingerprint and class of others at most, whatever the number
of links between them.

Defined results: a null or word-free text has fingerprint zero and links like
any other; repeated rows share fingerprint and component; the component id is
the smallest non-null id reachable (null if there is none); whole texts count.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, materialise, one_row_each, renamed, ship, text_digest
from shelfloom.operators import graph

SEED = 42
TILE = 4096
BLOCK_CELLS = 1 << 20
#: Rows and columns of a block that nearest links are looked for in: small enough for a processor's cache.
NEAR_BLOCK = (64, 4096)
#: A value's class is the parities of its bits under these masks, so that values of a dense group are of all classes.
CLASSES = tuple(int(m) for m in np.random.default_rng(7).integers(0, 1 << 63, 3))
SIDE = 17  # bit counts of a quarter: 0 to 16
CELLS = SIDE**4
BLOCK_HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: bit b is set if more than half of the shingles' hashes
    have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = len(stops)
    blocks = ([digest(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK_HASHES], stops[k : k + BLOCK_HASHES])] for k in range(0, total, BLOCK_HASHES))
    return majority(blocks, total)


def majority(blocks, total: int) -> int:
    """The bits that more than half of all ``total`` hashes of the blocks have."""
    ones = np.zeros(64, np.int64)
    for h in blocks:
        bits = np.unpackbits(np.asarray(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def signed(f: int) -> int:
    return f - (1 << 64) if f >> 63 else f


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a long (its 64 bits, signed)."""

    def factory():
        return lambda text: (signed(fingerprint(text, shingle)),)

    return add_columns(docs, [text_col], T.StructType([T.StructField(name, T.LongType())]), factory)


def _cells(fps: np.ndarray, grain: int = 1) -> np.ndarray:
    quarters = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64) // grain
    return quarters @ np.array([SIDE**3, SIDE**2, SIDE, 1])


def _near(radius: int, grain: int = 1) -> np.ndarray:
    """Differences of the four bit counts, in grains, that the radius allows."""
    top = min(SIDE, (radius + grain - 1) // grain)
    # counts of cells that are d grains apart differ by d * grain - (grain - 1) at least
    steps = [d for d in itertools.product(range(-top, top + 1), repeat=4) if sum(max(0, abs(x) * grain - grain + 1) for x in d) <= radius]
    return np.array(steps, np.int64)


def _sub(fps: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    mixed = fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % tiles.astype(np.uint64)).astype(np.int64)


def _star(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two arrays: all of them while they are few, else a forest
    with the same components."""
    # unsigned, as numpy counts the bits of a signed number's absolute value
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= radius
    i, j = np.nonzero(near)
    if len(i) <= 2 * (len(left) + len(right)):
        return left[i], right[j]
    # Propagate the smallest row number; each column takes the least of its rows.
    rows = np.arange(len(left))
    while True:
        spread = np.where(near, rows[:, None], len(left)).min(axis=0)
        back = np.where(near, spread[None, :], len(left)).min(axis=1)
        after = np.minimum(rows, back)
        if (after == rows).all():
            break
        rows = after
    linked = spread < len(left)
    return np.concatenate([left[rows], left[spread[linked]]]), np.concatenate([left, right[linked]])


def class_of(value: F.Column) -> F.Column:
    """Number of the value's class."""
    return sum((F.bit_count(value.bitwiseAND(F.lit(m))) % 2 * (1 << k) for k, m in enumerate(CLASSES)), F.lit(0))


def _classes(values: np.ndarray) -> np.ndarray:
    return sum((np.bitwise_count(values & m) % 2).astype(np.int64) << k for k, m in enumerate(CLASSES))


def _nearest(left: np.ndarray, right: np.ndarray, radius: int, room: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between two arrays: all of them while they are few, else to each
    value the nearest of the other array. ``room`` is memory for the cells."""
    shape = len(left), len(right)
    mixed, apart, near = (r[: len(left), : len(right)] for r in room) if room else (np.empty(shape, t) for t in (np.uint64, np.uint8, bool))
    # unsigned, as numpy counts the bits of a signed number's absolute value
    np.bitwise_xor(left.view(np.uint64)[:, None], right.view(np.uint64)[None, :], out=mixed)
    np.less_equal(np.bitwise_count(mixed, out=apart), radius, out=near)
    if not near.any():
        return left[:0], right[:0]
    i, j = np.nonzero(near)
    other = left[i] != right[j]
    i, j = i[other], j[other]
    if len(i) > 2 * (len(left) + len(right)):
        order = np.argsort(apart[i, j], kind="stable")
        i, j = i[order], j[order]
        best = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
        i, j = i[best], j[best]
    return left[i], right[j]


def _best(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links, each once, those that lead to the nearest of a class of others for one of their ends."""
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    kind = _classes(b)
    order = np.lexsort((b, np.bitwise_count((a ^ b).view(np.uint64)), kind, a))
    a, b, kind = a[order], b[order], kind[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (kind[1:] != kind[:-1])
    return _once(a[first], b[first])


def _once(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[first], v[first]


def _nearest_of_tiles(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or within one: all while they are few, else for each value the nearest of every class of
    others that its blocks name, so that a dense group's links grow with its values and not with their square."""
    few = 2 * (len(left) + len(right))
    rows, columns = NEAR_BLOCK
    room = tuple(np.empty(NEAR_BLOCK, t) for t in (np.uint64, np.uint8, bool))
    u, v = [left[:0]], [left[:0]]
    held = 0
    for k in range(0, len(left), rows):
        # within a tile the pairs above the diagonal do
        for m in range(k if left is right else 0, len(right), columns):
            a, b = _nearest(left[k : k + rows], right[m : m + columns], radius, room)
            u.append(a)
            v.append(b)
            held += len(a)
        if held > 16 * few:
            a, b = _best(np.concatenate(u), np.concatenate(v))
            u, v, held = [a], [b], len(a)
    a, b = _once(np.concatenate(u), np.concatenate(v))
    return _best(a, b) if len(a) > few else (a, b)


def _tiles(fps: DataFrame, sizes: np.ndarray, grain: int) -> DataFrame:
    """(tile, fps binary): the fingerprints of each tile together."""
    schema = pa.schema([("tile", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            f = batch.column(0).to_numpy()
            if len(f):
                cell = _cells(f, grain)
                tile = cell * (1 << 32) + _sub(f, sizes[cell])
                yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(f)], schema=schema)

    placed = fps.select("fp").mapInArrow(run, "tile long, fp long")
    return placed.groupBy("tile").agg(F.collect_list("fp").alias("fps"))


def _sent(tiles: DataFrame, sizes: np.ndarray, radius: int, grain: int) -> DataFrame:
    """(u, v, tile, fps): each tile under the key of every pair that it has to
    be compared in, with the tiles of the cells near its own and with itself."""
    steps = _near(radius, grain)
    sides = np.array([SIDE**3, SIDE**2, SIDE, 1])
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("tile", pa.int64()), ("fps", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tile = batch.column(0)[i].as_py()
                data = batch.column(1)[i].values.to_numpy().tobytes()
                cell = tile >> 32
                near = cell // sides % SIDE + steps
                near = near[((near >= 0) & (near < SIDE)).all(axis=1)] @ sides
                others = np.concatenate([(c << 32) + np.arange(sizes[c]) for c in near[sizes[near] > 0].tolist()])
                for k in range(0, len(others), 512):
                    part = others[k : k + 512]
                    columns = [np.minimum(part, tile), np.maximum(part, tile), np.full(len(part), tile)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([data] * len(part), pa.binary())], schema=schema)

    return tiles.mapInArrow(run, "u long, v long, tile long, fps binary")


def links(fps: DataFrame, radius: int = 3, tile: int = TILE, grain: int = 1, nearest: bool = False) -> DataFrame:
    """(u, v): links between distinct fingerprints that differ in 1 to
    ``radius`` bits, enough of them to connect every linked pair; with
    ``nearest`` those that are likeliest to stand a test that follows. ``fps``
    has one column ``fp`` of distinct values."""
    ship(fps.sparkSession)

    def count(batches):
        for batch in batches:
            f = batch.column(0).to_numpy()
            cell, n = np.unique(_cells(f, grain), return_counts=True) if len(f) else (f, f)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    # One number per cell, at most 83,521 whatever the size of the input.
    sums = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros(CELLS, np.int64)
    sizes[sums["cell"].to_numpy(dtype=np.int64)] = -(-sums["n"].to_numpy(dtype=np.int64) // tile)
    shape = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compared(left, right):
        for u, v in [_nearest_of_tiles(left, right, radius)] if nearest else (_star(*part, radius) for part in _blocks(left, right)):
            differ = u != v
            if differ.any():
                yield pa.RecordBatch.from_arrays([pa.array(u[differ]), pa.array(v[differ])], schema=shape)

    def compare(batches):
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                f = np.frombuffer(batch.column(3)[i].as_py(), np.int64)
                if key[0] == key[1]:
                    yield from compared(f, f)
                elif key == at:
                    yield from compared(held, f)
                else:
                    at, held = key, f

    sent = _sent(_tiles(fps, sizes, grain), sizes, radius, grain)
    # large tiles are few bytes for their work: a count of parts keeps adaptive execution from putting many pairs into one task
    parts = [min(4096, max(1, int(sizes.sum() * (sizes.sum() + 1) // 2)))] if nearest else []
    return sent.repartition(*parts, "u", "v").sortWithinPartitions("u", "v", "tile").mapInArrow(compare, "u long, v long").distinct()


def _blocks(left: np.ndarray, right: np.ndarray):
    step = max(1, BLOCK_CELLS // max(1, len(right)))
    for k in range(0, len(left), step):
        yield left[k : k + step], right


def least_row() -> F.Column:
    """What a group is named and led by: its smallest non-null id, and of the
    rows with that id the one with the smallest digest."""
    return F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_digest").alias("digest")))


def components(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, least) of every fingerprint in ``marked`` (_id, _digest, fp): the
    least row of its component."""
    smallest = materialise(marked.groupBy("fp").agg(least_row().alias("own")), "simhash-distinct")
    return named_components(smallest, links(smallest, radius), "fp")


def named_components(smallest: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, least) of every key in ``smallest`` (key, own)."""
    return named(smallest, materialise(graph.components(edges, "u", "v"), "simhash-groups"), key)


def named(smallest: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``named_components`` of the groups (node, component)."""
    # A group's members are few against the table; its least row is a grouped minimum.
    member = groups.join(smallest, F.col("node") == F.col(key)).select("node", "component", "own")
    leads = member.groupBy("component").agg(F.min("own").alias("group_least"))
    linked = groups.join(leads, "component").select("node", "group_least")
    return smallest.join(linked, F.col(key) == F.col("node"), "left").select(key, F.coalesce("group_least", "own").alias("least"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, digest: F.Column | None = None) -> DataFrame:
    """(_id, _digest, fp, least) of every row; ``digest`` tells rows of one id
    apart where that matters."""
    rows = renamed(docs, _id=id_col, _text=text_col).withColumn("_digest", F.lit(None).cast("binary") if digest is None else digest)
    marked = materialise(with_fingerprint(rows, text_col="_text", shingle=shingle).select("_id", "_digest", "fp"), "simhash-rows")
    # A written table, so that adaptive execution may split a hot fingerprint.
    named = materialise(components(marked, radius).withColumnRenamed("fp", "_fp"), "simhash-components")
    return marked.join(named, F.col("fp") == F.col("_fp")).select("_id", "_digest", "fp", "least")


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    return found.select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id")
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of every group, with all its columns: that of the smallest id,
    of several texts with this id the one with the smallest digest. Rows
    without id lead only where no row of the group has one. Ids, digests and
    groups are computed; the texts move once, in the join that takes out the
    other rows."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius, digest=text_digest("_text"))
    return leaders(docs, found, id_col=id_col, text_col=text_col)


def leaders(docs: DataFrame, found: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The row that leads each group of ``found`` (_id, _digest, least)."""
    leads = F.col("_id").eqNullSafe(F.col("least.id")) & (F.col("_digest") == F.col("least.digest"))
    return one_row_each(docs, found.select("_id", "_digest", leads.alias("_stays")), id_col=id_col, text_col=text_col)
