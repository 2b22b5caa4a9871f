"""Near-duplicates by the similarity of five-word shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is ``SIMILAR`` (0.8) or more. Links come by SimHash, as in ``simhash``:
fingerprints of the sets, tiles by the bit counts of four quarters, exclusive-or
and bit counts within ``RADIUS`` bits. Each is verified on the whole shingle sets, so
every link is right; what the verified links join is a component.

A fingerprint alone would lose links: at 0.8 the expected distance is 10 bits, and
about one pair in five is further apart than ``RADIUS``. So the rest is made up
for: MinHash signatures of ``BANDS`` bands of ``ROWS`` values bring together the sets
that share a band and agree in at least ``LEAST`` values of the whole signature, and
those that are not joined yet are verified too. A pair at exactly 0.8 shares
no band with probability (1 - 0.8^4)^32, about 5 in 10^8, and has under
``LEAST`` equal values about as rarely; more similar pairs are lost less often.

A bucket is a band value that several sets share. It is dealt into parts of about
``PART`` sets or ``PART_BYTES`` bytes of them, at random and anew for every band,
so that no bucket is one task's work. Of buckets with several components the signatures
come together, every two parts of a bucket in a task of their own; the shingle sets
follow of those that a pair agrees in there first, and such
pairs are verified until nothing more joins, so no pair is taken for
granted. This work is quadratic in the sets of one bucket that agree in
``LEAST`` values and are not joined; that of the tiles is quadratic in all sets.

Texts are read twice: for the signatures, and for the shingle sets of those that
have a link to verify or share a bucket. Which these are, the second pass learns from a bitmap of fixed
size, so that no text is shuffled to find out; it may let through too many, and
an exact join of what it hands on leaves those that are needed.

Defined results: as in ``simhash``; a text of fewer than five words is one
shingle; null and word-free texts are copies of each other and of nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.llm import simhash
from shelfloom.llm.common import add_columns, materialise, renamed, ship, text_digest
from shelfloom.operators import graph
from shelfloom.runtime import discard

SHINGLE = 5
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
LEAST = 77
BLOCK = 1 << 12
#: Bits that linked fingerprints differ in at most: beyond 12, links of unrelated texts outnumber those of near copies.
RADIUS = 12
#: Fingerprints of a tile, and bit counts of a quarter that share a cell. At this radius hardly any two cells are too far
#: apart to be compared, so they are few: each is sent to all others.
TILE, GRAIN = 1 << 16, 8
#: Sets, and bytes of sets, that a part of a bucket has on average at most; a task holds two parts.
PART = 512
PART_BYTES = 8 << 20
#: Bits of the map of wanted texts: 8 MiB, whatever the number of texts.
MAP_BITS = 1 << 26
_RNG = np.random.default_rng(42)
_XOR, _MUL = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_MUL |= np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, stops)), np.uint64, len(stops)))


def key_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signature(hashes: np.ndarray) -> bytes | None:
    """16 bits of each minimum; none for the empty set."""
    if not len(hashes):
        return None
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), BLOCK):
        mixed = (hashes[None, k : k + BLOCK] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    # the top bits of a minimum are mostly zero, so the number is mixed again
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2").tobytes()


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of the set, signed."""
    step = simhash.BLOCK_HASHES
    return simhash.signed(simhash.majority((hashes[k : k + step] for k in range(0, len(hashes), step)), len(hashes)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _marked(rows: DataFrame) -> DataFrame:
    """(_id, _digest, _key, _sig, _fp, _size) of every row; ``_fp`` is the
    fingerprint of the set, ``_size`` its bytes."""

    def factory():
        def one(text):
            h = shingles(text)
            return key_of(h), signature(h), fingerprint(h), h.nbytes

        return one

    out = T.StructType([*(T.StructField(n, T.BinaryType()) for n in ("_key", "_sig")), *(T.StructField(n, T.LongType()) for n in ("_fp", "_size"))])
    return add_columns(rows, ["_text"], out, factory).select("_id", "_digest", "_key", "_sig", "_fp", "_size")


def _alike(distinct: DataFrame) -> DataFrame:
    """(_a, _b): keys of sets whose fingerprints are linked by tiles, or equal. A
    fingerprint that several sets share stands for the least of them."""
    prints = distinct.filter("_sig is not null").select("_key", F.col("_fp").alias("fp"))
    first = materialise(prints.groupBy("fp").agg(F.min("_key").alias("_first")), "shingle-prints")
    near = simhash.links(first.select("fp"), RADIUS, TILE, GRAIN, nearest=True)
    # a fingerprint of a dense group has links in several tiles: of every class of others the nearest stays
    bits = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    ways = near.select("u", "v", bits.alias("_bits")).union(near.select(F.col("v"), F.col("u"), bits))
    kept = ways.groupBy("u", simhash.class_of(F.col("v"))).agg(F.min(F.struct("_bits", "v")).alias("_n"))
    near = kept.select(F.least("u", "_n.v").alias("u"), F.greatest("u", "_n.v").alias("v")).distinct()
    ends = (first.select(F.col("fp").alias(end), F.col("_first").alias(name)) for end, name in (("u", "_a"), ("v", "_b")))
    for end, side in zip("uv", ends):
        near = near.join(side, end)
    equal = prints.join(first, "fp").filter("_key <> _first").select(F.col("_key").alias("_a"), F.col("_first").alias("_b"))
    found = near.select("_a", "_b").union(equal)
    found = materialise(found.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "shingle-pairs")
    discard(first)
    return found


def _buckets(distinct: DataFrame) -> DataFrame:
    """(_bucket, _part, _last, _key): the sets that share a band value, one row a
    set and band. A bucket's number is a hash of the value with the band in its
    low bits. Buckets are counted first, which combines before the shuffle; then
    every set meets the number of parts of its bucket, a row a bucket, and names
    its part itself, so no task gets a bucket whole. ``_last`` is the bucket's
    last part."""
    schema = pa.schema([("_bucket", pa.int64()), ("_key", pa.binary()), ("_size", pa.int64())])
    bands = np.arange(BANDS, dtype=np.uint64)[None, :]
    away = 64 - MAP_BITS.bit_length() + 1

    def spread(batches, shipped=None):
        for batch in batches:
            n = batch.num_rows
            if n:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(n, BANDS)
                mixed = (values ^ (bands << np.uint64(40))) * _P
                mixed = ((mixed ^ (mixed >> np.uint64(32))) * _P) & ~np.uint64(31) | bands
                at = mixed >> np.uint64(away)
                there = np.ones(mixed.shape, bool) if shipped is None else (shipped.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                for band in range(BANDS):
                    hit = pa.array(there[:, band])
                    columns = pa.array(mixed[:, band].astype(np.int64)), batch.column(0), batch.column(2)
                    yield pa.RecordBatch.from_arrays([c.filter(hit) for c in columns], schema=schema)

    source, shape = distinct.filter("_sig is not null").select("_key", "_sig", "_size"), "_bucket long, _key binary, _size long"
    count, size = F.count(F.lit(1)), F.sum("_size")
    shared = source.mapInArrow(spread, shape).groupBy("_bucket").agg(count.alias("_n"), size.alias("_bytes")).filter("_n > 1")
    parts = F.greatest(F.ceil(F.col("_n") / PART), F.ceil(F.col("_bytes") / PART_BYTES)).cast("long")
    shared = materialise(shared.select(F.col("_bucket").alias("_shared"), F.least(parts, F.col("_n")).alias("_parts")), "shingle-shared")
    # most band values are one set's alone: the tasks leave these out before they are shuffled
    shipped = distinct.sparkSession.sparkContext.broadcast(_bitmap(shared.select(F.shiftrightunsigned("_shared", away).alias("at"))))  # MAP_BITS / 8 bytes
    rows = source.select("_key", "_sig", "_size").mapInArrow(lambda batches: spread(batches, shipped), shape)
    met = rows.join(shared, F.col("_bucket") == F.col("_shared"))
    part = F.pmod(F.xxhash64("_bucket", "_key"), F.col("_parts")).alias("_part")
    return met.select("_bucket", part, (F.col("_parts") - 1).alias("_last"), "_key")


def agreeing(sigs: np.ndarray, groups: np.ndarray, band: int, split: int):
    """(i, all j < i) of one part of a bucket, or of two of which the second
    begins at ``split``: those of different groups that agree enough, in the first
    band they share."""
    for i in range(max(1, split), len(sigs)):
        stop = split or i
        for k in range(0, stop, BLOCK):
            equal = sigs[k : min(stop, k + BLOCK)] == sigs[i]
            j = np.flatnonzero((equal.sum(axis=1) >= LEAST) & (groups[k : k + len(equal)] != groups[i]))
            if len(j):
                before = equal[j].reshape(len(j), BANDS, ROWS)[:, :band].all(axis=2).any(axis=1)
                yield i, k + j[~before]


def pairs(sigs: np.ndarray, groups: np.ndarray, band: int, split: int):
    """Candidates (i, j), i > j, of ``agreeing``."""
    for i, found in agreeing(sigs, groups, band, split):
        for j in found.tolist():
            # the caller may have joined the groups since
            if groups[j] != groups[i]:
                yield i, j


def _in_parts(rows: DataFrame, done, shape: str) -> DataFrame:
    """What ``done(bucket, u, v, held)`` makes of the rows of each pair of parts
    (_bucket, _u, _v, _part, _key, _sig, _group, ...), a list from ``_part`` on."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            # one row after another: of a batch only the rows of one pair of parts are held twice
            for bucket, u, v, *one in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):
                if (bucket, u, v) != at:
                    if len(held) > 1:
                        yield from done(*at, held)
                    at, held = (bucket, u, v), []
                held.append(one)
        if len(held) > 1:
            yield from done(*at, held)

    dealt = rows.repartition("_bucket", "_u", "_v").sortWithinPartitions("_bucket", "_u", "_v", "_part", "_key")
    return dealt.mapInArrow(run, shape)


def _told(bucket, u, v, held):
    """Signatures, numbers of groups, band and split, as ``pairs`` takes them."""
    sigs = np.frombuffer(b"".join(h[2] for h in held), "<u2").reshape(len(held), BANDS * ROWS)
    ids = np.unique(np.array([h[3] for h in held], object), return_inverse=True)[1]
    return sigs, ids, bucket & 31, sum(h[0] == u for h in held) if u != v else 0


def _agreed(rows: DataFrame) -> DataFrame:
    """The rows of pairs of parts (_bucket, _u, _v, _part, _key, _sig, _group)
    that have a candidate there, each once."""
    schema = pa.schema([(n, pa.int64()) for n in ("_bucket", "_u", "_v", "_part")] + [(n, pa.binary()) for n in ("_key", "_sig", "_group")])

    def done(bucket, u, v, held):
        met = np.zeros(len(held), bool)
        for i, found in agreeing(*_told(bucket, u, v, held)):
            met[found] = True
            met[i] |= len(found) > 0
        kept = [[bucket, u, v, *held[k]] for k in np.flatnonzero(met).tolist()]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema, strict=True)], schema=schema)

    return _in_parts(rows, done, "_bucket long, _u long, _v long, _part long, _key binary, _sig binary, _group binary")


def _compared(rows: DataFrame) -> DataFrame:
    """(u, v): groups of pairs of parts (_bucket, _u, _v, _part, _key, _sig,
    _group, _set) that verified links join, enough of these for all similar
    pairs."""
    shape = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def done(bucket, u, v, held):
        names = [h[3] for h in held]
        sigs, ids, band, split = _told(bucket, u, v, held)
        a, b = [], []
        for i, j in pairs(sigs, ids, band, split):
            if not similar(np.frombuffer(held[i][4], "<u8"), np.frombuffer(held[j][4], "<u8")):
                continue
            ids[ids == ids[j]] = ids[i]
            a.append(names[i])
            b.append(names[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=shape)

    return _in_parts(rows, done, "u binary, v binary").distinct()


def _fitting(candidates: DataFrame, distinct: DataFrame) -> DataFrame:
    """The candidates (_a, _b) whose sizes allow them to be similar enough: no set
    is needed to refuse the others."""
    for end in ("_a", "_b"):
        candidates = candidates.join(distinct.select(F.col("_key").alias(end), F.col("_size").alias(f"_size{end}")), end)
    least, most = F.least("_size_a", "_size_b"), F.greatest("_size_a", "_size_b")
    return materialise(candidates.filter(SIMILAR[1] * least >= SIMILAR[0] * most).select("_a", "_b"), "shingle-fitting")


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the candidates that are similar enough."""
    left = sets.select(F.col("_key").alias("_a"), F.col("_set").alias("_left"))
    right = sets.select(F.col("_key").alias("_b"), F.col("_set").alias("_right"))
    shape = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches):
        for batch in batches:
            sides = (batch.column(k) for k in (2, 3))
            fit = [similar(*(np.frombuffer(x.as_py(), "<u8") for x in ab)) for ab in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fit, pa.bool_())) for c in batch.columns[:2]], schema=shape)

    both = candidates.join(left, "_a").join(right, "_b").select("_a", "_b", "_left", "_right")
    return materialise(both.mapInArrow(run, "u binary, v binary"), "shingle-links")


def _bitmap(places: DataFrame) -> np.ndarray:
    """Which numbers under ``MAP_BITS`` occur (at), as bits of 64-bit words. The
    tasks make the pieces; ``MAP_BITS`` / 8 bytes reach the driver."""
    piece = 1 << 16
    schema = pa.schema([("piece", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        at, words = None, None
        for batch in batches:
            place = batch.column(0).to_numpy()
            number = place // piece
            for k in np.unique(number).tolist():
                if k != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([words.tobytes()], pa.binary())], schema=schema)
                    at, words = k, np.zeros(piece // 64, np.uint64)
                bit = place[number == k] % piece
                np.bitwise_or.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([words.tobytes()], pa.binary())], schema=schema)

    dealt = places.select("at").repartition(F.expr(f"at div {piece}")).sortWithinPartitions("at")
    out = np.zeros((MAP_BITS // piece, piece // 64), np.uint64)
    for r in dealt.mapInArrow(run, "piece long, bits binary").collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint64)
    return out.reshape(-1)


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_key, _set, _sig) of the sets of ``wanted`` (_key, _text), written: each
    is made from the one text with that digest."""
    shipped = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.pmod(F.xxhash64("_text"), F.lit(MAP_BITS)).alias("at"))))  # MAP_BITS / 8 bytes
    digest = text_digest("_text")
    keyed = rows.select(F.pmod(F.xxhash64(digest), F.lit(MAP_BITS)).alias("_at"), digest.alias("_digest"), "_text")
    schema = pa.schema([("_digest", pa.binary()), ("_set", pa.binary()), ("_sig", pa.binary())])

    def run(batches):
        there = shipped.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = there[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            for k in np.array_split(np.flatnonzero(hit), len(at) // 512 + 1):
                if len(k):
                    part = batch.take(pa.array(k))
                    made = [shingles(t) for t in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array([h.tobytes() for h in made], pa.binary()), pa.array(map(signature, made), pa.binary())], schema=schema)

    made = keyed.mapInArrow(run, "_digest binary, _set binary, _sig binary")
    # texts that repeat become one by digest, which is what they are joined by: the sets are shuffled once
    exact = made.dropDuplicates(["_digest"]).join(wanted, F.col("_digest") == F.col("_text")).select("_key", "_set", "_sig")
    out = materialise(exact, "shingle-sets")
    shipped.destroy()
    return out


def components(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, component) of every key whose set is similar enough to another.
    ``distinct`` has (_key, _text, _sig, _fp, _size), the digest of one text, the
    signature and the fingerprint of each set."""
    linked = _alike(distinct)
    candidates = _fitting(linked, distinct)
    buckets = materialise(_buckets(distinct), "shingle-buckets")
    needed = buckets.select("_key").union(candidates.select("_a")).union(candidates.select("_b")).distinct()
    held = materialise(distinct.join(needed, "_key", "left_semi").select("_key", "_text"), "shingle-held")
    sets = _sets(rows, held)
    first = _verified(candidates, sets)
    groups = materialise(graph.components(first, "u", "v"), "shingle-groups")
    named = buckets.join(groups, F.col("_key") == F.col("node"), "left").select("_bucket", "_part", "_last", "_key", F.coalesce("component", "_key").alias("_group"))
    # a bucket of one component has nothing left to compare
    open_ = named.groupBy("_bucket").agg(F.min("_group").alias("_l"), F.max("_group").alias("_m"), F.max("_last").alias("_last"))
    rest = named.drop("_last").join(open_.filter("_l < _m").select("_bucket", "_last"), "_bucket").withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    rest = rest.withColumns({"_u": F.least("_part", "_other"), "_v": F.greatest("_part", "_other")}).join(sets.select("_key", "_sig"), "_key")
    agreed = materialise(_agreed(rest.select("_bucket", "_u", "_v", "_part", "_key", "_sig", "_group")), "shingle-agreed")
    rest = agreed.join(sets.select("_key", "_set"), "_key")
    rest = materialise(_compared(rest.select("_bucket", "_u", "_v", "_part", "_key", "_sig", "_group", "_set")), "shingle-links")
    # groups are the nodes of the second graph, so it is as small as what the tiles have missed
    joined = materialise(graph.components(rest, "u", "v"), "shingle-joined")
    other = joined.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    named = groups.join(other, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    out = materialise(named.union(joined.join(groups, "node", "left_anti").select("node", "component")), "shingle-groups")
    for done in (linked, candidates, agreed, buckets, held, sets, first, groups, rest, joined):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest, _key, least) of every row."""
    ship(docs.sparkSession)
    rows = renamed(docs, _id=id_col, _text=text_col)
    marked = materialise(_marked(rows.withColumn("_digest", text_digest("_text"))), "shingle-rows")
    distinct = marked.groupBy("_key").agg(
        simhash.least_row().alias("own"), F.min("_digest").alias("_text"), F.min("_sig").alias("_sig"), F.min("_fp").alias("_fp"), F.min("_size").alias("_size")
    )
    distinct = materialise(distinct, "shingle-distinct")
    named = simhash.named(distinct.select("_key", "own"), components(rows, distinct), "_key").select(F.col("_key").alias("_k"), "least")
    named = materialise(named, "shingle-components")
    return marked.join(named, F.col("_key") == F.col("_k")).select("_id", "_digest", "_key", "least")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group, with all its columns, chosen as in
    ``simhash.keep_one``."""
    return simhash.leaders(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
