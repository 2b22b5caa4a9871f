"""Files on disk, dedup, similarity, media, actions, reports, streaming."""

import datetime
import os
import struct
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfloom import actions, flows, report, runtime
from shelfloom.config import RECOVERY_FILTERS, Filters, Priorities, Safety, load, load_safety
from shelfloom.functions import images
from shelfloom.functions import jpeg as jpegs
from shelfloom.operators import dedup, filters, graph, quality, ranking, selection, similar, tiles
from shelfloom.sources import files as source
from shelfloom.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tree(tmp_path):
    for name, size in {"good.jpg": 2000, "sub/good2.jpg": 2000, "sub/deep/er/x.jpg": 3000, "tiny.jpg": 100, "photo_backup_1.jpg": 2000, ".dotfile.jpg": 2000, ".hiddendir/inside.jpg": 2000, "_x.png": 5000}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes([len(name)]) * size)
    (tmp_path / "folder.jpg").mkdir()
    return tmp_path


def test_scan_and_skip_reasons(spark, tree):
    found = source.files(spark, [str(tree), str(tree / "sub")], [".jpg", ".png"])
    got = {os.path.relpath(r.path, tree): r.skip_reason for r in filters.scanned(found).collect()}
    assert got == {
        "good.jpg": None, "sub/good2.jpg": None, "sub/deep/er/x.jpg": None, "_x.png": None, "tiny.jpg": "too_small",
        "photo_backup_1.jpg": "excluded_pattern", ".dotfile.jpg": "hidden", ".hiddendir/inside.jpg": "hidden", "folder.jpg": "not_regular",
    }
    own = filters.scanned(found, filters=Filters(own_output=(str(tree / "sub"),)))
    assert own.filter("skip_reason = 'own_output'").count() == 2
    assert filters.kept(filters.scanned(found, filters=RECOVERY_FILTERS)).count() == 7
    summary = [(r.reason, r.n) for r in filters.skip_summary(filters.scanned(found)).collect()]
    assert dict(summary) == {"too_small": 1, "excluded_pattern": 1, "hidden": 2, "not_regular": 1}
    assert filters.advice(summary, Filters()) == "would_help" and filters.advice(summary, RECOVERY_FILTERS) == "already_on"
    assert filters.scanned(found, []).count() == 0 and source.files(spark, []).count() == 0
    assert source.files(spark, [str(tree / "missing")]).count() == 0


def test_duplicates_by_extension(spark):
    rows = [(f"/v/{e}{k}.{e}", f".{e}", b"same") for e in ("mp4", "mov", "mkv") for k in range(2)] + [("/v/o.mp4", ".mp4", b"diff"), ("/v/e.mp4", ".mp4", b"")]
    df = spark.createDataFrame([(p, e, len(c), c) for p, e, c in rows], "path string, ext string, size long, content binary")
    assert dedup.totals(dedup.duplicate_groups(df)).first()[:] == (3, 6, 3)
    assert dedup.totals(dedup.duplicate_groups(df, by_extension=False)).first()[:] == (1, 6, 5)
    assert dedup.totals(dedup.duplicate_groups(df.limit(0))).first()[:] == (0, 0, 0)


def test_sample_step(spark, tmp_path):
    mib = 1 << 20
    a, b = b"a" * 3 * mib, b"a" * mib + b"x" * mib + b"a" * mib
    data = {"a.mp4": a, "b.mp4": b"b" * 3 * mib, "c.mp4": b"c" * 3 * mib, "d.mp4": b"c" * 3 * mib, "e.mp4": b}
    for n, c in data.items():
        (tmp_path / n).write_bytes(c)
    found = source.with_content(source.files(spark, [str(tmp_path)], [".mp4"]))
    s = dedup.sample_stats(found).first()
    assert dedup.sample_stats(found.limit(0)).first()[:] == (0,) * 6
    assert (s.scanned, s.size_candidates, s.sample_candidates, s.naive_bytes, s.sampled_bytes) == (5, 5, 4, 15 * mib, 10 * mib)
    assert sorted(os.path.basename(r.path) for r in dedup.duplicate_rows(dedup.sample_candidates(found)).collect()) == ["c.mp4", "d.mp4"]
    by_path = dedup.duplicate_rows(dedup.hash_candidates(found.drop("content")))
    assert sorted(os.path.basename(r.path) for r in by_path.collect()) == ["c.mp4", "d.mp4"]
    import hashlib

    streamed = {os.path.basename(r.path): r.sha256 for r in source.streamed_hashes(found).collect()}
    assert streamed == {n: hashlib.sha256(c).hexdigest() for n, c in data.items()}
    sampled = {r.path: r.sha256 for r in source.streamed_hashes(found, mib).collect()}
    from shelfloom.functions.hashing import sample_hash

    assert sampled == {r.path: r.h for r in found.select("path", sample_hash(F.col("content"), F.col("size")).alias("h")).collect()}


def test_content_is_never_shuffled(spark):
    """Every exchange of every exact-duplicate plan, without broadcasts."""
    rows = spark.range(50).selectExpr("concat('/v/', id) path", "'.x' ext", "id % 7 size", "cast(concat('c', id % 7) as binary) content").cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (dedup.duplicate_groups(rows), dedup.duplicate_rows(rows), dedup.sample_stats(rows, 2), dedup.sample_candidates(rows, 2), dedup.size_candidates(rows), dedup.totals(dedup.duplicate_groups(rows, False))):
            def under(node, below):
                below = below or node.nodeName().startswith("Exchange")
                if below and "InMemory" not in node.nodeName():
                    inputs = [node.children().apply(k) for k in range(node.children().size())]
                    if node.nodeName().startswith("Exchange"):
                        assert "content" not in inputs[0].output().toString(), inputs[0].toString()
                for k in range(node.children().size()):
                    under(node.children().apply(k), below)

            under(made._jdf.queryExecution().executedPlan(), False)
            assert made.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        rows.unpersist()


def test_duplicates_of_odd_files(spark):
    rows = [("a", ".x", 1, b"1"), ("b", ".x", 1, b"1"), ("b", ".x", 1, b"1"), ("c", None, 1, b"1"), ("d", ".x", None, None), ("e", ".x", None, None), ("f", ".x", 0, b""), ("g", ".x", 0, b"")]
    df = spark.createDataFrame(rows, "path string, ext string, size long, content binary")
    assert sorted(r.path for r in dedup.duplicate_rows(df).collect()) == ["a", "b", "b", "f", "g"]
    assert sorted((r.first, r.n) for r in dedup.duplicate_groups(df).collect()) == [("a", 3), ("f", 2)]
    assert sorted(r.path for r in dedup.size_candidates(df).collect()) == ["a", "b", "b", "f", "g"]
    assert sorted((r.first, r.n) for r in dedup.duplicate_groups(df, by_extension=False).collect()) == [("a", 4), ("f", 2)]
    assert dedup.duplicate_rows(df.limit(0)).count() == dedup.duplicate_groups(df.limit(0)).count() == 0


def test_numbers_inside_groups_of_any_size(spark):
    rows = [("hot", k * 37 % 500) for k in range(500)] + [(None, 3), (None, 1), ("x", 9)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = {(r.g, r.v): r.k for r in ranking.numbered(df, ["g"], ["v"], "k").collect()}
    assert got == {("hot", v): v + 1 for v in range(500)} | {(None, 1): 1, (None, 3): 2, ("x", 9): 1}
    low = ranking.per_group(df, "g", F.min("v").alias("low"), F.count("v").alias("n"))
    assert {(r.g, r.low, r.n) for r in low.collect()} == {("hot", 0, 500), (None, 1, 2), ("x", 9, 1)}
    assert ranking.numbered(df.limit(0), ["g"], ["v"], "k").count() == 0


def test_tiles_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = rng.integers(-(1 << 63), (1 << 63) - 1, (150, 2))
    for k in range(40, 110):
        words[k] = words[k % 7]
        for bit in rng.integers(0, 128, 9):
            words[k, bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64))
    other = rng.integers(0, 2, 150)
    rows = [(f"p{k:03d}", [int(x) for x in w], [int(o), 0]) for k, (w, o) in enumerate(zip(words, other))]
    df = spark.createDataFrame(rows, "rep string, phash array<long>, dhash array<long>")
    near = lambda a, b: int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    want = {(f"p{i:03d}", f"p{j:03d}", near(words[i], words[j])) for i in range(150) for j in range(i + 1, 150) if near(words[i], words[j]) <= 30}
    both = {w for w in want if other[int(w[0][1:])] == other[int(w[1][1:])]}
    for tile in (16, 4096):
        monkeypatch.setattr(tiles, "TILE", tile)
        assert {tuple(r) for r in tiles.near_pairs(df, 30, ["phash"]).collect()} == want
        forest = tiles.near_pairs(df, 30, ["phash"], forest=True)
        assert {tuple(r) for r in forest.collect()} <= want
        root = {r.node: r.component for r in graph.components(forest, "a", "b").collect()}
        assert root == {r.node: r.component for r in graph.components(spark.createDataFrame(list(want), "a string, b string, d int"), "a", "b").collect()}
    assert len(both) < len(want) == len(set(want)) and want
    near_two = df.withColumn("dhash", F.transform("dhash", lambda x: -x))
    assert {tuple(r)[:3] for r in tiles.near_pairs(near_two, 30, ["phash", "dhash"]).filter("distance2 = 0").collect()} == both
    assert tiles.near_pairs(df.limit(0), 30, ["phash"]).count() == 0


def test_spanning_cells_join_what_all_cells_join():
    rng = np.random.default_rng(5)
    for _ in range(200):
        near = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.choice([0.02, 0.1, 0.5, 1.0])
        i, j = tiles.spanning(near)
        assert near[i, j].all() and len(i) <= max(2 * sum(near.shape), len(i))

        def parts(pairs):
            seen = {}

            def find(x):
                while seen.setdefault(x, x) != x:
                    x = seen[x]
                return x

            for a, b in pairs:
                seen[find(("r", a))] = find(("c", b))
            groups = {}
            for x in list(seen):
                groups.setdefault(find(x), set()).add(x)
            return sorted(map(sorted, groups.values()))

        assert parts(zip(*map(np.ndarray.tolist, np.nonzero(near)))) == parts(zip(i.tolist(), j.tolist()))


def test_banded_join_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    words = [int(b) for b in base] + [int(b) ^ int(np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 60, rng.integers(1, 9)))) for b in base for _ in range(3)]
    words += words[:5]
    df = spark.createDataFrame([(f"p{k:03d}", [w], [w ^ 5]) for k, w in enumerate(words)], "path string, phash array<long>, dhash array<long>")
    for threshold in (0, 5, 8):
        got = {(r.a, r.b) for r in similar.hamming_pairs(df, threshold).collect()}
        first = {}
        for k, w in enumerate(words):
            first.setdefault(w, f"p{k:03d}")
        want = {tuple(sorted((first[x], first[y]))) for x in first for y in first if first[x] < first[y] and bin((x ^ y) & (1 << 64) - 1).count("1") <= threshold}
        assert got == want


def test_similarity_rules(spark):
    def groups(rows, threshold):
        df = spark.createDataFrame(rows, "path string, phash array<long>, dhash array<long>")
        return {r.path for r in similar.similar_groups(df, threshold).collect()}

    assert groups([("a", [0], [0]), ("b", [15], [0x7FF])], 5) == set()
    assert groups([("a", [0], [0]), ("b", [15], [1])], 5) == {"a", "b"}
    assert groups([("a", [0], [0]), ("b", [15], None)], 5) == set()
    chain = spark.createDataFrame([(str(k), [(1 << k) - 1]) for k in range(4)], "path string, phash array<long>")
    found = similar.similar_groups(chain, 1, secondary=False)
    assert {(r.path, r.component) for r in found.collect()} == {(str(k), "0") for k in range(4)}
    pct = {r.other: r.pct for r in similar.similarity_to_first(found, chain).collect()}
    assert pct == {"1": 98.4, "2": 96.9, "3": 95.3}
    wide = spark.createDataFrame([("a", [0, 0]), ("b", [1, 1]), ("c", [-1, 0])], "path string, phash array<long>")
    assert [(r.a, r.b, r.distance) for r in similar.hamming_pairs(wide, 8, 100, secondary=False).collect()] == [("a", "b", 2)]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 130)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def png(pixels):
    h, w = pixels.shape
    raw = b"".join(b"\0" + bytes(row) for row in pixels.astype(np.uint8))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(pixels, quality=1, colour=False, restart=0):
    """A baseline file with two made-up code tables: 8-bit codes for all symbols
    would do, but lengths differ so that the reader is put to work."""
    h, w = pixels.shape
    zig = jpegs._ZIGZAG
    tall, wide = -(-h // 16) * 16, -(-w // 16) * 16
    full = np.pad(pixels.astype(float), ((0, tall - h), (0, wide - w)), mode="edge") - 128
    quant = np.full(64, quality)

    def coefficients(plane):
        blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        return np.round(jpegs._BASIS.T @ blocks @ jpegs._BASIS / quality).astype(int).reshape(*blocks.shape[:2], 64)[:, :, zig]

    dc_symbols, ac_symbols = list(range(12)), [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    dc_counts, ac_counts = [0, 1, 2, 2, 2, 5] + [0] * 10, [0, 1, 0, 0, 0, 0, 0, 100, 0, 61] + [0] * 6

    def codes(counts, symbols):
        out, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                out[symbols[at]] = format(code, f"0{length}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    dc, ac = codes(dc_counts, dc_symbols), codes(ac_counts, ac_symbols)

    def value(v):
        n = int(abs(v)).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(found, last):
        n, bits = value(int(found[0]) - last)
        out, run = dc[n] + bits, 0
        for v in found[1 : (np.flatnonzero(found)[-1] + 1 if found.any() else 1)]:
            if not v:
                run += 1
                continue
            while run > 15:
                out, run = out + ac[0xF0], run - 16
            n, bits = value(int(v))
            out, run = out + ac[run << 4 | n] + bits, 0
        return out + (ac[0] if not found[63] else "")

    y = coefficients(full)
    parts = [(y, 2 if colour else 1)] + ([(coefficients(np.zeros((tall // 2, wide // 2))), 1)] * 2 if colour else [])
    units = [(r, c) for r in range(tall // 16) for c in range(wide // 16)] if colour else [(r, c) for r in range(-(-h // 8)) for c in range(-(-w // 8))]
    scan, bits, last = b"", "", [0, 0, 0]
    for n, (r, c) in enumerate(units):
        if restart and n and n % restart == 0:
            bits += "1" * (-len(bits) % 8)
            scan += bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            bits, last = "", [0, 0, 0]
        for p, (found, size) in enumerate(parts):
            for v in range(size):
                for x in range(size):
                    one = found[r * size + v, c * size + x]
                    bits += block(one, last[p])
                    last[p] = int(one[0])
    bits += "1" * (-len(bits) % 8)
    scan += bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    n = len(parts)
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes(quant.tolist()))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, (0x22 if colour and k == 0 else 0x11), 0]) for k in range(n)))
    out += part(0xC4, b"\0" + bytes(dc_counts) + bytes(dc_symbols)) + part(0xC4, b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    out += part(0xDD, struct.pack(">H", restart)) if restart else b""
    return out + part(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0") + scan + b"\xff\xd9"


def gif(pixels):
    h, w = pixels.shape
    bits, width, size, codes = "", 9, 258, []
    data = pixels.astype(np.uint8).tobytes()
    words, last = {bytes([k]): k for k in range(256)}, b""
    codes.append((256, 9))
    for b in data:
        if last + bytes([b]) in words:
            last += bytes([b])
            continue
        codes.append((words[last], width))
        if size < 4096:
            words[last + bytes([b])] = size
            size += 1
            width += size > (1 << width) and width < 12
        last = bytes([b])
    codes += [(words[last], width), (257, width)]
    bits = "".join(format(c, f"0{n}b")[::-1] for c, n in codes)
    packed = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    blocks = b"".join(bytes([len(packed[k : k + 255])]) + packed[k : k + 255] for k in range(0, len(packed), 255))
    table = bytes(v for k in range(256) for v in (k, k, k))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + table + b"!\xf9\4\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0;"


def tiff(pixels, packed=8):
    h, w = pixels.shape
    body = pixels.astype(np.uint8).tobytes()
    body = zlib.compress(body) if packed == 8 else body
    tags = [(256, w), (257, h), (258, 8), (259, packed), (262, 1), (273, 8 + 2 + 12 * 8 + 4), (277, 1), (279, len(body))]
    return b"II*\0" + struct.pack("<IH", 8, 8) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + b"\0" * 4 + body


def picture(seed=1, h=60, w=80):
    x = np.random.default_rng(seed).normal(size=(6, 8)).cumsum(axis=0).cumsum(axis=1)
    x = np.kron(x, np.ones((10, 10)))[:h, :w]
    return np.clip(128 + 90 * (x - x.mean()) / x.std() / 2, 0, 255).round()


def test_pixels_of_every_decoder():
    x = picture()
    for data, off in ((jpeg(x), 2), (jpeg(x, 3, colour=True), 8), (jpeg(x, 1, colour=True, restart=3), 2), (jpeg(x, 2, restart=5), 4), (gif(x), 0), (tiff(x), 0), (tiff(x, 1), 0), (png(x), 0)):
        got = images.grey(data)
        assert got.shape == x.shape and np.abs(got - x).max() <= off + 1e-9, images.header(data)
    for data in (jpeg(x), jpeg(x, 2, colour=True), gif(x), tiff(x), png(x)):
        assert images.verdict(data, ".x") == "ok"
        for share in (0.5, 0.8, 0.95):
            assert images.verdict(data[: int(len(data) * share)], ".x") == "corrupt", (images.header(data), share)
        bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
        assert bits(images.phash(images.grey(data))[0], images.phash(x)[0]) <= 5 and bits(images.dhash(images.grey(data))[0], images.dhash(x)[0]) <= 5
    other = jpeg(x).replace(b"\xff\xc0", b"\xff\xc2")
    assert images.verdict(other, ".jpg") == "unsupported" and images.verdict(other[:-2], ".jpg") == "corrupt"
    webp = b"RIFF" + struct.pack("<I", 92) + b"WEBPVP8L" + b"\x10\0\0\0/" + b"\x0f\xc0\x03\0" + b"\0" * 80
    assert images.verdict(webp, ".webp") == "unsupported" and images.verdict(webp[:70], ".webp") == "corrupt"
    assert images.verdict(b"II*\0" + b"\0" * 60, ".tif") == "corrupt" and images.verdict(b"\0" * 60, ".cr2") == "unsupported"


@pytest.mark.parametrize("depth,laced", [(1, 0), (2, 1), (4, 0), (8, 1), (16, 0), (16, 1)])
def test_png_depths_and_passes(depth, laced):
    top = (1 << depth) - 1
    x = np.random.default_rng(depth).integers(0, top + 1, (13, 11))
    raw = b""
    for a, b, c, d in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if laced else ((0, 0, 1, 1),):
        for row in x[a::c, b::d]:
            if row.size:
                bits = "".join(format(v, f"0{depth}b") for v in row)
                bits += "0" * (-len(bits) % 8)
                raw += b"\0" + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 11, 13, depth, 0, 0, 0, laced)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.allclose(images.grey(data), x >> 8 if depth == 16 else x * (255 / top))


def test_exif_of_every_container():
    text = {0x010F: b"Maker\0", 0x0132: b"2020:01:02 03:04:05\0", 0xFFFE: b"odd one\0"}
    body, data = b"", b""
    start = 8 + 2 + 12 * 3 + 4
    for tag, value in sorted(text.items()):
        body += struct.pack("<HHII", tag, 2, len(value), start + len(data))
        data += value
    exif = b"II*\0" + struct.pack("<IH", 8, 3) + body + b"\0" * 4 + data
    want = {"Make": "Maker", "DateTime": "2020:01:02 03:04:05", "65534": "odd one"}
    part = lambda mark, b: bytes([0xFF, mark]) + struct.pack(">H", len(b) + 2) + b
    x = png(picture())
    placed = x[:33] + struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif)) + x[33:]
    webp = b"RIFF" + struct.pack("<I", 4) + b"WEBP" + b"EXIF" + struct.pack("<I", len(exif)) + exif
    for data in (exif, b"\xff\xd8" + part(0xE1, b"Exif\0\0" + exif), placed, webp):
        assert images.exif_tags(data) == want
    assert images.exif_tags(b"GIF89a" + b"\0" * 60) == {} == images.exif_tags(exif[:20])


def test_media(spark):
    x = np.random.default_rng(1).integers(20, 230, (60, 80))
    good = png(x)
    bad = good[:60] + b"\0" * 20 + good[80:]
    rows = [("a", ".png", good), ("b", ".png", bad), ("c", ".png", b""), ("d", ".cr2", b"x" * 100), ("e", ".jpg", b"y" * 100), ("f", ".png", None), ("g", ".png", png(x + 1)), ("g", None, png(x + 1))]
    found = images.media(spark.createDataFrame(rows, "path string, ext string, content binary")).collect()
    got = {r.path: r for r in found}
    assert len(found) == len(rows) and images.media(spark.createDataFrame(rows[:0], "path string, ext string, content binary")).count() == 0
    assert {k: r.verdict for k, r in got.items()} == {"a": "ok", "b": "corrupt", "c": "corrupt", "d": "unsupported", "e": "corrupt", "f": "corrupt", "g": "ok"}
    assert (got["a"].width, got["a"].height, got["a"].format) == (80, 60, "PNG") and got["c"].phash is None
    assert bin((got["a"].phash[0] ^ got["g"].phash[0]) & (1 << 64) - 1).count("1") <= 5 and len(images.phash(x.astype(float), 16)) == 4
    assert images.header(jpeg(x)) == (80, 60, "JPEG", "L") and images.header(b"GIF89a\x05\0\x06\0") == (5, 6, "GIF", "P")
    assert images.can_decode(".jpg") and not images.can_decode(".CR2") and not images.can_decode(".webp")


def test_noise_that_begins_like_a_picture(spark):
    """Of 65,536 files of noise one begins with BM and one with the mark of a JPEG."""
    noise = bytes.fromhex("c3b311775fd387d0340a72650c9362b68a3e813f098941f4a147426a59d6") * 3
    for begin in (b"BM", b"\xff\xd8"):
        data = begin + noise + b"\xff\xc0\0\x11\x08\0\x10\0\x10\x03" + noise
        assert images.header(data) is None
        assert images.verdict(data, ".jpg") == "corrupt" and images.verdict(data, ".heic") == "unsupported"
    body = lambda size, *more: b"BM" + struct.pack("<IHHI", 100, 0, 0, 54) + struct.pack("<I", size) + struct.pack(*more)
    assert images.header(body(40, "<iiHH", 9, -8, 1, 24)) == (9, 8, "BMP", "RGB") == images.header(body(12, "<HHHH", 9, 8, 1, 24))
    assert images.header(body(40, "<iiHH", 9, 8, 3, 24)) is None is images.header(body(41, "<iiHH", 9, 8, 1, 24))
    assert images.verdict(body(12, "<HHHH", 9, 8, 1, 24) + b"\0" * 300, ".bmp") == "unsupported"
    # sides that the columns cannot hold do not end the job
    wide = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBBBBB", 1 << 31, 1, 8, 0, 0, 0, 0) + b"\0" * 60
    rows = [("wide", ".png", wide), ("tall", ".bmp", body(40, "<iiHH", 9, -(1 << 31), 1, 24) + b"\0" * 300)]
    found = images.media(spark.createDataFrame(rows, "path string, ext string, content binary")).collect()
    assert [(r.width, r.verdict) for r in found] == [(None, "corrupt")] * 2


def test_similar_flow_over_files(spark, tmp_path):
    """Folder to ledger to report and back."""
    x, other = picture(1), picture(9)
    made = {"IMG_20200101_101010.png": png(x), "IMG_20200101_101010 (1).jpg": jpeg(x, 2), "sub/copy of it.gif": gif(x), "other.png": png(other), "other2.tif": tiff(np.clip(other + 1, 0, 255)), "alone.png": png(picture(30)),
            "broken.jpg": jpeg(x)[:900], "raw.cr2": b"r" * 3000}
    for name, data in made.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    result = flows.similar_ledger(spark, [str(tmp_path / "in")], scan=Filters(min_size_bytes=0))
    base = lambda p: os.path.basename(p)
    rows = result["ledger"].collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.grp, []).append((base(r.path), r.is_kept))
    members = sorted(sorted(n for n, _ in g) for g in groups.values())
    assert members == [["IMG_20200101_101010 (1).jpg", "IMG_20200101_101010.png", "copy of it.gif"], ["other.png", "other2.tif"]]
    assert all(sum(k for _, k in g) == 1 for g in groups.values()) and ("IMG_20200101_101010.png", True) in sum(groups.values(), [])
    assert result["totals"].first()[:] == (3, 2) and result["scanned"] == 8
    assert result["unhashed"] == {"total": 2, "names": ["broken.jpg", "raw.cr2"], "more": 0, "decoders": ["raw"]}
    assert {(base(r.path), r.verdict) for r in flows.corrupt_files(spark, [str(tmp_path / "in")], Filters(min_size_bytes=0)).collect()} == {("broken.jpg", "corrupt"), ("raw.cr2", "unsupported")}
    info = {r.path: r.asDict() for r in result["info"].collect()}
    percent = {(r.anchor, r.other): r.pct for r in result["percent"].collect()}
    assert len(percent) == 3 and min(percent.values()) >= 92
    listed = [
        {"kept": next(r.path for r in rows if r.grp == g and r.is_kept), "reason": "tie", "losers": [(r.path, "tie_alphabetical", percent.get((g, r.path))) for r in rows if r.grp == g and not r.is_kept]} for g in sorted(groups)
    ]
    moves = actions.move([(r.path, str(tmp_path / "bin" / base(r.path))) for r in rows if not r.is_kept], survivors={r.path: next(q.path for q in rows if q.grp == r.grp and q.is_kept) for r in rows if not r.is_kept}, dry_run=False)
    assert {m.outcome for m in moves} == {"moved"}
    text = report.render("similar", listed, moves, info, dry_run=False, bin_path=str(tmp_path / "bin"))
    path = report.write(str(tmp_path / "reports"), "similar", "x", text)
    assert {(r.original, r.reported) for r in report.parse(spark, [path]).collect()} == {(m.original, m.destination) for m in moves}
    back = report.parse_groups(spark, [path])
    assert {(r.path, r.is_kept) for r in back.collect()} == {(r.path, r.is_kept) for r in rows}
    one = back.filter(F.col("name") == "IMG_20200101_101010.png").first()
    assert (one.width, one.height, one.filename_importance, one.date_source, one.extracted_date) == (80, 60, info[one.path]["filename_importance"], "filename", "2020-01-01 10:10:10")
    again = selection.replay_causes(report.replayable(back)).collect()
    # a report holds sizes to a hundredth of a MB, so only the group that the names decide is sure to be decided alike
    assert len(again) == 2 and [r.cause for r in again if r.kept_before == one.path and r.kept_after == one.path] == [None]


def test_report_lines_of_another_writer(spark, tmp_path):
    lines = ["Title", "\U0001f9e9 Group #1", "\U0001f7e2 Kept Image:", "  \U0001f4c4 a.jpg", "  \U0001f4c1 Path: C:/x/a.jpg", "  \U0001f4be Size: 1.5 MB", "  \U0001f4d0 Dimensions: 10x20",
             "\U0001f4cc Selection Reason: older", "\u274c Deleted Images:", "  \U0001f4c4 b.jpg", "  \U0001f4c1 Path: C:/x/b.jpg", "  \U0001f4e5 Moved to: D:/bin/b.jpg", "  \U0001f4e5 Moved to: D:/bin/again.jpg",
             "  \U0001f4c5 Date Extracted: 2020-01-02 00:00:00 (day only)", "  \U0001f4c4 c.jpg", "  \U0001f4c1 Path: C:/x/c.jpg"]
    (tmp_path / "similar_1.txt").write_text("\r\n".join(lines), encoding="utf-8")
    (tmp_path / "similar_2.txt").write_text("")
    paths = [str(tmp_path / f"similar_{k}.txt") for k in (1, 2)]
    assert [(r.original, r.reported) for r in report.parse(spark, paths).collect()] == [("C:/x/b.jpg", "D:/bin/b.jpg")]
    rows = {r.name: r for r in report.parse_groups(spark, paths).collect()}
    assert (rows["a.jpg"].is_kept, rows["a.jpg"].size_mb, rows["a.jpg"].width, rows["a.jpg"].reason) == (True, 1.5, 10, "older")
    assert not rows["b.jpg"].is_kept and rows["c.jpg"].extracted_date is None
    assert str(report.replayable(report.parse_groups(spark, paths)).filter("name = 'b.jpg'").first().ts) == "2020-01-02 00:00:00"


def test_exact_flow_over_files(spark, tmp_path):
    for name, data in {"a.docx": b"x" * 2000, "b (1).docx": b"x" * 2000, "c.pdf": b"x" * 2000, "d.mp4": b"v" * 2000, "20180817.mp4": b"v" * 2000, "e.png": b"i" * 2000, "e.jpg": b"i" * 2000}.items():
        (tmp_path / name).write_bytes(data)
    kept = {}
    for section in ("office", "video", "images", "archives"):
        kept[section] = {(os.path.basename(r.path), r.is_kept) for r in flows.exact_ledger(spark, [str(tmp_path)], section).select("path", "is_kept").collect()}
    assert kept == {"office": {("a.docx", True), ("b (1).docx", False)}, "video": {("20180817.mp4", True), ("d.mp4", False)}, "images": {("e.jpg", True), ("e.png", False)}, "archives": set()}
    typed = flows.exact_ledger(spark, [str(tmp_path)], "other", extensions=[".png", ".docx"])
    assert typed.count() == 2


def test_walk_hands_folders_on(spark, tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / f"d{k % 5}" / f"e{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 5}" / f"e{k}" / f"{k}.txt").write_text("x")
    monkeypatch.setattr(source, "SHARE", 3)
    got = source.files(spark, [str(tmp_path), str(tmp_path / "d1")], [".txt"]).collect()
    assert sorted(int(r.name[:-4]) for r in got) == list(range(30)) and all(r.size == 1 and not r.hidden for r in got)


def test_destinations_meet_no_other_file(spark):
    rows = [("1", "f", "a.jpg"), ("2", "f", "a.jpg"), ("3", "f", "a_1.jpg"), ("4", "f", "a.jpg"), ("5", "f", "a.jpg"), ("6", "g", "a.jpg"), ("7", "f", "x"), ("8", "f", "x"), ("9", "f", ".rc"), ("10", "f", ".rc"), ("11", "f", None)]
    df = spark.createDataFrame(rows, "path string, folder string, name string")
    got = {r.path: r.destination for r in actions.destinations(df, "/b", "s").collect()}
    named = {p: d.removeprefix("/b/s/") for p, d in got.items()}
    assert {k: named[k] for k in "123456789"} == {"1": "f/a.jpg", "2": "f/a_2.jpg", "3": "f/a_1.jpg", "4": "f/a_3.jpg", "5": "f/a_4.jpg", "6": "g/a.jpg", "7": "f/x", "8": "f/x_1", "9": "f/.rc_1"}
    assert named["10"] == "f/.rc" and len(got) == 11
    taken = spark.createDataFrame([("f", "a.jpg"), ("f", "a_3.jpg"), ("g", "b.jpg")], "folder string, name string")
    again = {r.path: r.destination.removeprefix("/b/s/") for r in actions.destinations(df, "/b", "s", taken).collect()}
    assert [again[k] for k in "12345"] == ["f/a_2.jpg", "f/a_4.jpg", "f/a_1.jpg", "f/a_5.jpg", "f/a_6.jpg"] and again["6"] == "g/a.jpg"
    assert actions.destinations(df.limit(0), "/b", "s").count() == 0
    assert actions.session_folders(["p", "q", "p"], {"p", "p (2)"}) == {"p": "p (3)", "q": "q"}


def test_located_counts_names_once(spark):
    bins = spark.createDataFrame([("/b/x/n.jpg", "n.jpg", 5), ("/b/y/n.jpg", "n.jpg", 6), ("/b/z/n_1.jpg", "n_1.jpg", 6), ("/b/q.jpg", "q.jpg", 1)], "path string, name string, size long")
    rows = [("/o/n.jpg", "/b/w/n.jpg", 5), ("/o/n.jpg", "/b/w/n.jpg", 5), ("/o/n.jpg", "/b/w/n.jpg", 9), ("/o/n.jpg", "/b/w/n_1.jpg", None), ("/o/q.jpg", "/b/q.jpg", 7), ("/o/n.jpg", "/b/w/gone.jpg", 6), ("/o/none.jpg", None, 1), (None, None, None)]
    removed = spark.createDataFrame(rows, "original string, reported string, size long")
    got = sorted(((r.actual, r.status) for r in actions.located(removed, bins).collect()), key=str)
    assert got == sorted([("/b/x/n.jpg", "found")] * 2 + [("/b/x/n.jpg", "ambiguous"), ("/b/z/n_1.jpg", "found"), ("/b/q.jpg", "found"), ("/b/y/n.jpg", "ambiguous"), (None, "missing"), (None, "missing")], key=str)
    assert actions.located(removed.limit(0), bins).count() == 0 and actions.located(removed, bins.limit(0)).filter("status = 'missing'").count() == 8


def test_access_column(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    df = spark.createDataFrame([(str(tmp_path / "a"), 1), (str(tmp_path / "gone"), 2), (None, 3)], "path string, n int")
    assert {r.n: r.access for r in actions.with_access(df).collect()} == {1: "available", 2: "protected", 3: "protected"}


def test_move_report_restore(spark, tmp_path):
    keep, lose = tmp_path / "a.txt", tmp_path / "b.txt"
    keep.write_text("same")
    lose.write_text("same")
    plan = [(str(lose), str(tmp_path / "bin" / "b.txt"))]
    kept_by = {str(lose): str(keep)}
    assert actions.move(plan, survivors=kept_by)[0].outcome == "dry_run" and lose.exists()
    both = [*plan, (str(keep), str(tmp_path / "bin" / "a.txt"))]
    swapped = actions.move(both, survivors={**kept_by, str(keep): str(lose)}, dry_run=False)
    assert [m.outcome for m in swapped] == ["skipped_error"] * 2 and keep.exists() and lose.exists()
    moves = actions.move(plan, survivors=kept_by, dry_run=False)
    assert moves[0].outcome == "moved" and not lose.exists()
    assert actions.move(plan, survivors=kept_by, dry_run=False)[0].outcome == "gone"
    # another group's survivor exists, but this file's own does not
    (tmp_path / "c.txt").write_text("other")
    only = actions.move([(str(keep), str(tmp_path / "bin" / "a.txt"))], survivors={str(keep): str(lose), "x": str(tmp_path / "c.txt")}, dry_run=False)
    assert only[0].outcome == "skipped_error" and keep.exists()
    single = actions.move([(str(tmp_path / "c.txt"), str(tmp_path / "bin" / "c.txt"))], dry_run=False)
    assert single[0].outcome == "moved"
    text = report.render_files("small_images", [(str(tmp_path / "c.txt"), "width")], single, dry_run=False, bin_path="bin")
    assert f"Moved to: {single[0].destination}" in text and "  width: 1" in text
    text = report.render("duplicates", [{"kept": str(keep), "reason": "criterion_decided", "criterion": "date", "losers": [(str(lose), "lower_date")]}], moves, dry_run=False, bin_path="bin")
    paths = [report.write(str(tmp_path / "reports"), "duplicates", "20260101", text) for _ in range(2)]
    report.write(str(tmp_path / "reports"), "duplicate_video", "20260101", text)
    found = report.find_reports(str(tmp_path / "reports"), "images")
    assert len(set(paths)) == 2 and found["duplicates"] == sorted(paths, reverse=True) and found["similar"] == []
    removed = report.parse(spark, paths[:1]).withColumn("size", F.lit(4).cast("long"))
    in_bin = source.files(spark, [str(tmp_path / "bin")])
    found = [(r.original, r.actual, r.status) for r in actions.located(removed, in_bin).collect()]
    assert found == [(str(lose), moves[0].destination, "found")]
    assert actions.restore(found) == [(str(lose), "would_restore")]
    assert actions.restore(found, dry_run=False) == [(str(lose), "restored")] and lose.read_text() == "same"
    assert actions.restore(found, dry_run=False) == [(str(lose), "already_there")]
    lose.write_text("other text")
    assert actions.restore(found, dry_run=False)[0][1] == "restored" and (tmp_path / "b_restored.txt").exists()
    assert actions.restore([("x", None, "missing")]) == [("x", "missing")]
    assert "  missing: 1\n  restored: 1\n  ambiguous: 2" in report.render_restore([("x", "missing"), ("y", "restored")], 2)
    assert report.operation_of("small_images_2026.txt", "images") == "small_images" and report.operation_of("small_images_1.txt", "video") is None
    assert report.operation_of("duplicate_video_1.txt", "video") == "duplicate_video" and report.operation_of("duplicate_video_1.txt", "images") is None
    assert actions.cleaned_folder("/data/photos/2020/x.jpg", "/home/me") == "data/photos/2020"


def test_settings(tmp_path):
    path = tmp_path / "settings.json"
    assert load(str(path)) == (Filters(), Priorities())
    path.write_text("[1, 2")
    assert load(str(path)) == (Filters(), Priorities())
    path.write_text('{"filters": {"max_file_size_mb": 0, "include_hidden": true, "exclude_patterns": []}, "priorities": {"order": [1, 2, 3, 4], "date_priority": "Newest", "name_gate_date_gap_hours": "x", "enabled": {"size": false}}}')
    filters_, priorities = load(str(path))
    assert filters_ == RECOVERY_FILTERS and filters_.recovery
    assert priorities.order == (1, 2, 3, 4) and not priorities.oldest and priorities.gate_gap_hours == 24 and not priorities.enabled["size"]
    path.write_text('{"filters": 3, "priorities": {"order": [1, 1, 2, "3"]}}')
    assert load(str(path)) == (Filters(), Priorities())


def test_safety(tmp_path):
    path = tmp_path / "s.json"
    assert load_safety(str(path)) == Safety()
    path.write_text('{"safety": {"max_files_per_operation": "x", "dry_run_mode": false}}')
    assert load_safety(str(path)) == Safety(dry_run=False)
    path.write_text('{"safety": {"max_files_per_operation": "5", "confirm_before_delete": false}}')
    limited = load_safety(str(path))
    assert limited == Safety(confirm=False, max_files=5)
    assert actions.refusal(5, limited) is None
    assert actions.refusal(6, limited) == "too_many"
    assert actions.refusal(6, limited, large_confirmed=True) is None
    assert actions.refusal(10**6, Safety()) == "unconfirmed"
    assert actions.refusal(10**6, Safety(), confirmed=True) is None


def test_replay_and_video_reasons(spark):
    t = lambda d: datetime.datetime(2020, 1, d, 12)
    # grp, path, name, pixels, size, importance, provenance, ts, was_kept
    rows = [
        ("g", "g/1", "IMG_1.jpg", 100, 100, 8, 4, t(1), False), ("g", "g/2", "IMG_1 (1).jpg", 100, 100, 3, 1, t(1), True),
        ("h", "h/1", "IMG_2.jpg", 100, 100, 8, 4, t(1), False), ("h", "h/2", "IMG_3.jpg", 100, 100, 8, 4, t(9), True),
        ("i", "i/1", "IMG_4.jpg", 100, 100, 8, 4, t(1), True), ("i", "i/2", "IMG_5.jpg", 100, 100, 8, 4, t(9), False),
        ("j", "j/1", "IMG_6.jpg", 100, 100, 8, 4, t(1), False),
    ]
    df = spark.createDataFrame(rows, "grp string, path string, name string, pixels long, size long, importance int, provenance int, ts timestamp_ntz, was_kept boolean")
    df = df.withColumns({"ts_source": F.lit("exif"), "old_ts": F.lit(None).cast("timestamp_ntz"), "old_source": F.lit("none"), "mtime": F.col("ts")})
    got = {r.grp: (r.kept_after, r.cause) for r in selection.replay_causes(df).collect()}
    assert got == {"g": ("g/1", "name_gate"), "h": ("h/1", "date_restored"), "i": ("i/1", None)}
    why = {r.path: (r.against, r.decided_by, r.date_note) for r in selection.video_reasons(selection.ranked_videos(df)).collect()}
    assert why["g/1"] == ("g/2", "provenance", None) and why["g/2"] == ("g/1", "provenance", None)
    assert why["h/1"] == ("h/2", "date", "older") and why["h/2"] == ("h/1", "date", None) and "j/1" not in why


def test_stream(spark, tmp_path):
    schema = "path string, ext string, content binary"
    data, known, out = (str(tmp_path / n) for n in ("in", "known", "out"))
    for k, rows in enumerate([[("a", ".x", b"1"), ("b", ".x", b"1")], [("c", ".x", b"1"), ("d", ".x", b"2")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
        incremental.dedup_stream(spark.readStream.schema(schema).parquet(data), known, out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.path, r.first_path) for r in spark.read.parquet(out).collect()} == {("b", "a"), ("c", "a")}
    assert spark.read.parquet(known).count() == 2


def test_ledger_and_samples(spark, tmp_path):
    moves = [actions.Move("/a", "/b/a", "moved"), actions.Move("/c", None, "failed")]
    paths = [actions.write_ledger(moves, str(tmp_path / "ledger.json"), section="video", dry_run=False, bin_path="/b") for _ in range(2)]
    rows = spark.read.json(paths[0]).collect()
    assert paths[0] != paths[1] and {(r.original, r.outcome, r.failed, r.bin, r.section) for r in rows} == {("/a", "moved", 1, "/b", "video"), ("/c", "failed", 1, "/b", "video")}
    diff = spark.createDataFrame([(f"g{k:02d}", "a", "a" if k % 2 else "b") for k in range(40)], "grp string, kept_before string, kept_after string")
    assert [g for g, _, _ in selection.changed_samples(diff)] == [f"g{k:02d}" for k in range(0, 24, 2)]
    assert quality.examples(spark.createDataFrame([(f"p{k}",) for k in range(9)], "path string")) == [f"p{k}" for k in range(5)]
    files = spark.createDataFrame([("/x/r/a", "a", 5000), ("/x/r-old/a", "a", 1), (None, None, None)], "path string, name string, size long")
    skips = filters.scanned(files, filters=Filters(own_output=("/x/r/",)))
    assert filters.in_order(filters.skip_summary(skips)) == [("own_output", 1), ("too_small", 1)]


def test_entry_without_the_optional_part():
    """What the optional part needs may be missing; the rest has to work."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'best_file' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) == set(q)"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=top, timeout=120).returncode == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        runtime.shared_dir(Session)


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return f"{v:.4f}"
    return str(v)


CORE = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in "part documents embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda df: sorted(repr(tuple(map(_cell, r))) for r in df[names].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 21
