"""The near stage's links come by fingerprints in tiles, and what those miss is made up for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import common, shingles, simhash


def apart(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize("grain,tile,nearest", [(4, 64, False), (4, 1 << 14, True), (3, 64, True), (1, 4096, False)])
def test_wide_links_lose_no_neighbour(spark, grain, tile, nearest):
    rng = np.random.default_rng(grain)
    prints = set(rng.integers(0, 1 << 64, 150, dtype=np.uint64).tolist())
    for b in list(prints)[:15]:
        for _ in range(20):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(simhash.signed(p) for p in prints)
    radius = 4 if grain == 1 else shingles.RADIUS
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, tile, grain, nearest).collect()}
    assert got and all(0 < apart(u, v) and (apart(u, v) <= radius or not nearest) for u, v in got)  # a forest links through its root
    linked = {x for pair in got for x in pair}
    assert linked == {p for p in prints if any(p != q and apart(p, q) <= radius for q in prints)}


def test_nearest_links_of_a_dense_block():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    near = np.array(sorted({simhash.signed(base ^ 1 << int(a) ^ 1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))}), np.int64)
    u, v = simhash._nearest(near, near, 12)
    assert len(near) < len(u) <= 2 * len(near) and (u != v).all()
    for p in near.tolist():
        least = min(apart(p, q) for q in near.tolist() if q != p)
        assert least in {apart(p, int(b if a == p else a)) for a, b in zip(u.tolist(), v.tolist()) if p in (a, b)}


def copies(n):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        base = [f"w{rng.randint(0, 900)}" for _ in range(60)]
        for j in range(4):
            rows.append((10 * k + j, " ".join(base[: 20 + j] + [f"x{j}"] * (j > 0) + base[20 + j :])))
    return rows


def test_links_come_by_fingerprints_and_the_rest_is_made_up(spark, monkeypatch):
    docs = spark.createDataFrame(copies(30), "doc_id long, text string")
    marked = shingles._marked(common.renamed(docs, _id="doc_id", _text="text").withColumn("_digest", common.text_digest("_text")))
    prints = {bytes(r._key): r._fp for r in marked.select("_key", "_fp").collect()}
    found = [(prints[bytes(r._a)], prints[bytes(r._b)]) for r in shingles._alike(marked.select("_key", "_sig", "_fp")).collect()]
    want = sum(apart(a, b) <= shingles.RADIUS for k, a in enumerate(prints.values()) for b in list(prints.values())[:k])
    # of others in one class only the nearest is named
    assert 60 < 0.9 * want < len(found) <= want and all(apart(*pair) <= shingles.RADIUS for pair in found)
    whole = sorted(r.doc_id for r in shingles.keep_one(docs).collect())
    asked = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *more, **named: asked.append(fps.count()) or real(fps.filter(F.lit(False)), *more, **named))
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == whole and asked == [len(set(prints.values()))]


def test_sets_of_one_fingerprint(spark):
    """Equal fingerprints of different sets are links to verify, not copies."""
    rows = [(bytes([k]), b"s", 7 if k < 3 else k, 8) for k in range(5)]
    found = shingles._alike(spark.createDataFrame(rows, "_key binary, _sig binary, _fp long, _size long")).collect()
    got = {(bytes(r._a), bytes(r._b)) for r in found}
    assert {(b"\1", b"\0"), (b"\2", b"\0")} <= got and (b"\2", b"\1") not in got


def test_links_of_a_dense_group_grow_with_its_values(spark):
    def count(n):
        rng = np.random.default_rng(11)
        base, prints = int(rng.integers(0, 1 << 64, dtype=np.uint64)), set()
        while len(prints) < n:
            x = base
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            prints.add(simhash.signed(x))
        fps = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
        return simhash.links(fps, shingles.RADIUS, 1 << 16, 17, nearest=True).count()

    small, large = count(2000), count(8000)
    assert 2000 < small <= 8 * 2000 and large <= 8 * 8000 and large < 5 * small


def test_nearest_of_every_class(spark):
    rng = np.random.default_rng(5)
    u, v = rng.integers(-1 << 63, 1 << 63, (2, 4000))
    v[:3000] = u[rng.integers(0, 50, 3000)]  # some values have many links
    a, b = simhash._best(u, v)
    links = spark.createDataFrame(zip(u.tolist(), v.tolist()), "u long, v long")
    bits = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("bits")
    ways = links.select("u", "v", bits).union(links.select("v", "u", bits))
    kept = ways.groupBy("u", simhash.class_of(F.col("v"))).agg(F.min(F.struct("bits", "v")).alias("n"))
    want = {(min(r.u, r.n.v), max(r.u, r.n.v)) for r in kept.collect()}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) < 4000


def test_buckets_are_those_that_sets_share(spark):
    docs = spark.createDataFrame(copies(30), "doc_id long, text string")
    marked = shingles._marked(common.renamed(docs, _id="doc_id", _text="text").withColumn("_digest", common.text_digest("_text")))
    sigs = {bytes(r._key): bytes(r._sig) for r in marked.collect()}
    width = 2 * shingles.ROWS
    met = {}
    for key, sig in sigs.items():
        for band in range(shingles.BANDS):
            met.setdefault((band, sig[band * width : (band + 1) * width]), []).append(key)
    want = sorted((band, sorted(keys)) for (band, _), keys in met.items() if len(keys) > 1)
    found = {}
    for r in shingles._buckets(marked.select("_key", "_sig", "_size")).collect():
        found.setdefault(r._bucket, []).append(bytes(r._key))
    assert want and sorted((b & 31, sorted(keys)) for b, keys in found.items()) == want


def test_only_sets_of_agreeing_pairs_follow(spark):
    sig = np.arange(shingles.BANDS * shingles.ROWS, dtype="<u2")
    other = sig + np.uint16(500)
    other[:4] = sig[:4]  # shares the first band and nothing else
    late = sig.copy()
    late[:28] += np.uint16(900)  # of the bands, the eighth is the first that it shares
    rows = [(0, 0, 0, 0, bytes([k]), s.tobytes(), bytes([g])) for k, s, g in ((1, sig, 1), (2, sig, 2), (3, other, 3), (4, sig, 1))]
    rows += [(7, 0, 0, 0, bytes([k]), s.tobytes(), bytes([k])) for k, s in ((1, sig), (5, late), (2, sig))]
    shape = "_bucket long, _u long, _v long, _part long, _key binary, _sig binary, _group binary"
    got = sorted((r._bucket, bytes(r._key)) for r in shingles._agreed(spark.createDataFrame(rows, shape)).collect())
    assert got == [(0, b"\1"), (0, b"\2"), (0, b"\4"), (7, b"\1"), (7, b"\2"), (7, b"\5")]


def test_sizes_refuse_before_sets(spark):
    distinct = spark.createDataFrame([(b"a", 800), (b"b", 640), (b"c", 632), (b"d", 1000)], "_key binary, _size long")
    pairs = [(b"a", b"b"), (b"a", b"c"), (b"d", b"a"), (b"d", b"b")]
    got = {(bytes(r._a), bytes(r._b)) for r in shingles._fitting(spark.createDataFrame(pairs, "_a binary, _b binary"), distinct).collect()}
    assert got == {(b"a", b"b"), (b"d", b"a")}
