"""Files, ledgers, journals and indexes on disk; groups, hubs and hashes of any size."""

import os
import random
import re
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom import bin_index, journal, ledger
from shelfloom.actions import destinations, located
from shelfloom.config import Filters
from shelfloom.functions import matching
from shelfloom.operators import filters, graph, probing, ranking, similar, tiles
from shelfloom.sources import balance, files, library


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for folder in ("a/.h/deep", "wide", "own", "a/dir.jpg"):
        (top / folder).mkdir(parents=True)
    for k in range(700):
        (top / "wide" / f"f{k}.jpg").write_bytes(b"x" * k)
    for name in ("a/x.jpg", "a/.y.jpg", "a/.h/z.png", "a/.h/deep/q.jpg", "a/b.tmp", "own/o.jpg", "none"):
        (top / name).write_bytes(b"hello" * 300)
    os.symlink(top / "nowhere", top / "a/broken.jpg")
    return str(top)


# --- the data source -----------------------------------------------------------------------------


def test_library_reads_what_the_walker_reads(spark, tree, monkeypatch):
    got = {r.path: tuple(r) for r in library.read(spark, [tree], wide="100", numPartitions="4").collect()}
    want = {r.path: tuple(r) for r in files.files(spark, [tree]).collect()}
    # a folder named like a file is seen by the source, and by the walker if such files are wanted
    assert set(got) - set(want) == {f"{tree}/a/dir.jpg"} and all(got[p] == want[p] for p in want)
    flags = {p.removeprefix(tree + "/"): r for p, r in got.items()}
    assert flags["a/broken.jpg"][7] and flags["a/dir.jpg"][8] and flags["a/.h/deep/q.jpg"][9] and not flags["a/x.jpg"][9]


def test_library_pushes_filters_into_the_walk(spark, tree):
    wanted = library.read(spark, [tree]).filter(
        F.col("ext").isin(".jpg", ".png") & ~F.col("hidden") & (F.col("size") >= 100) & F.col("path").startswith(f"{tree}/wide/") & ~F.col("name").endswith("9.jpg")
    )
    text = plan_of(wanted)
    pushed = re.search("PushedFilters: (.*)", text)[1]
    for part in ("In(ext, [.jpg,.png])", "Not(EqualTo(hidden,true))", "GreaterThanOrEqual(size,100)", "StringStartsWith(path", "Not(StringEndsWith(name,9.jpg))"):
        assert part in pushed
    assert "Filter (" not in text  # nothing is left for Spark to test
    assert wanted.count() == sum(k >= 100 and k % 10 != 9 for k in range(700))
    assert library.read(spark, [tree]).filter("size is null").count() == 1
    assert library.read(spark, [tree]).filter("lower(ext) = '.tmp' and size > 3").count() == 1


def test_library_closes_folders_that_nothing_may_pass():
    walk = library.Walk(["/r"], 4, 100)
    from pyspark.sql import datasource as D

    assert not list(walk.pushFilters([D.EqualTo(("hidden",), False), D.StringStartsWith(("path",), "/r/a/b")]))
    assert walk._open("/r/a", False) and walk._open("/r/a/b/c", False) and not walk._open("/r/x", False) and not walk._open("/r/a/b", True)
    other = D.EqualTo(("mtime",), 1)
    assert list(walk.pushFilters([other])) == [other]


def test_a_wide_folder_is_shared_by_tasks(spark, tree):
    found = library.read(spark, [f"{tree}/wide"], wide="100", numPartitions="8")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 700 and len(sizes) >= 7 and max(sizes) < 160


def test_a_million_entries_are_several_tasks(tmp_path):
    """The shares of a folder, each with its part of the names, without a million files."""
    names = [f"IMG_{k:07d}.jpg" for k in range(1_000_000)]
    import zlib

    shares = -(-len(names) // library.WIDE)
    dealt = Counter(zlib.crc32(n.encode()) % shares for n in names)
    assert shares == 50 and len(dealt) == 50 and max(dealt.values()) < 1.1 * library.WIDE


def test_walker_hands_wide_folders_on_and_keeps_overlaps_once(spark, tree):
    got = files.files(spark, [tree, f"{tree}/a/.h", f"{tree}/a/.h"])
    paths = [r.path for r in got.collect()]
    assert len(paths) == len(set(paths)) == files.files(spark, [tree]).count()
    # a file below a root that is itself hidden is not hidden for that root
    assert not got.filter(F.col("path").endswith("z.png")).first().hidden
    assert "HashAggregate" not in plan_of(files.files(spark, [tree]))


def test_skips_are_counted_by_the_scan(spark, tree):
    scan = Filters(min_size_bytes=50, own_output=(f"{tree}/own",))
    scanned = filters.scanned(library.read(spark, [tree]), [".jpg", ".png", ".tmp"], scan)
    found, seen = filters.counted(scanned)
    assert filters.kept(found).count() == 651
    got = {tuple(r) for r in filters.observed_summary(spark, seen).collect()}
    assert got == {tuple(r) for r in filters.skip_summary(scanned).collect()}
    assert seen.get["scanned"] == scanned.count()
    assert plan_of(filters.kept(found)).count("BatchScan") == 2  # one node, named twice


# --- balanced bytes ------------------------------------------------------------------------------


def test_partitions_have_about_the_same_bytes(spark):
    rng = random.Random(3)
    rows = [(f"p{k}", min(2_000_000, int(rng.paretovariate(1.1) * 1000))) for k in range(20_000)] + [("none", None), ("p1", 5), ("odd", -3)]
    found = balance.balanced(spark.createDataFrame(rows, "path string, size long"), F.col("size"), "path", parts=40)
    sums = [r.s for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.greatest("size", F.lit(0))).alias("s")).collect()]
    assert found.count() == len(rows) and len(sums) == 40 and max(sums) < 2 * sum(sums) / 40
    assert balance.balanced(spark.createDataFrame([], "path string, size long"), F.col("size"), "path").count() == 0
    assert balance.partitions_for(10 << 30, 4) == 40


def test_streamed_hashes_read_by_bytes(spark, tree):
    import hashlib

    found = library.read(spark, [tree]).filter("ext = '.jpg' and not not_regular and not unreadable").select("path", "size")
    whole = {r.path: r.sha256 for r in files.streamed_hashes(found).collect()}
    sample = {r.path: r.sha256 for r in files.streamed_hashes(found, 32).collect()}
    assert len(whole) == found.count()
    for path, digest in whole.items():
        data = open(path, "rb").read()
        assert digest == hashlib.sha256(data).hexdigest()
        part = data[:32] + (data[-32:] if len(data) > 64 else b"")
        assert sample[path] == hashlib.sha256(len(data).to_bytes(8, "big") + part).hexdigest()


# --- running sums, hubs, hashes ------------------------------------------------------------------


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, "b"]), rng.choice(["x", None]), k, rng.randint(0, 9)) for k in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h string, k int, v long").repartition(7)
    got = {(r.g, r.h, r.k): (r.s, r.n) for r in ranking.numbered(ranking.running(df, ["g", "h"], ["k"], "v", "s"), ["g", "h"], ["k"], "n").collect()}
    sums, counts, want = Counter(), Counter(), {}
    for g, h, k, v in sorted(rows, key=lambda r: r[2]):
        sums[g, h] += v
        counts[g, h] += 1
        want[g, h, k] = (sums[g, h], counts[g, h])
    assert got == want
    assert sorted(r.n for r in ranking.numbered(df, [], ["k"], "n").collect()) == list(range(1, 5001))
    assert ranking.numbered(df.limit(0), ["g"], ["k"], "n").count() == 0


def test_destinations_take_few_shuffles_and_split_a_hot_name(spark):
    rows = [(f"/x/{k:05d}/thumb.jpg", "thumb.jpg", "f") for k in range(3000)] + [("/y/thumb_2.jpg", "thumb_2.jpg", "f"), ("/z/n", None, None), ("/z/m", None, None)]
    df = spark.createDataFrame(rows, "path string, name string, folder string")
    taken = spark.createDataFrame([("f", "thumb.jpg"), ("f", "thumb_5.jpg"), ("f", "thumb_5.jpg")], "folder string, name string")
    out = destinations(df, "/bin", "s", taken)
    got = {r.path: r.destination for r in out.collect()}
    free = (k for k in range(1, 10_000) if k not in (2, 5))
    assert all(got[p] == f"/bin/s/f/thumb_{next(free)}.jpg" for p, n, _ in rows[:3000])
    assert got["/y/thumb_2.jpg"] == "/bin/s/f/thumb_2.jpg" and len(got) == len(rows)
    assert plan_of(out).count("Exchange (") <= 2  # of the written parts only unions are left


def test_components_of_a_star_do_not_meet_in_one_task(spark):
    n = 1_000_000
    star = spark.range(1, n + 1, 1, 8).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    both = star.union(star.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for key, value in zip(keep, ("false", "16", "-1"), strict=True):
        spark.conf.set(key, value)
    try:
        met = graph._met(both, least, max(graph.HUB, 2 * n // graph.HUBS))
        found = met.groupBy(F.spark_partition_id().alias("p"), (F.col("u") == 0).alias("hub")).agg(F.count(F.lit(1)).alias("n"), F.min("m"), F.max("m")).collect()
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)
    for hub in (False, True):
        sizes = sorted(r.n for r in found if r.hub == hub)
        assert sum(sizes) == n and len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    linked = graph.components(star.sample(0.02, 3), "u", "v")
    assert linked.select("component").distinct().count() == 1


def hashes(rng, n, copies, flips):
    base = rng.integers(-(2**63), 2**63 - 1, n)
    near = [int(b) ^ int(np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, rng.integers(1, flips)))) for b in base for _ in range(copies)]
    return sorted({*map(int, base), *near})


def brute(words, threshold):
    w = np.array(words, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(w[:, None] ^ w[None, :]) <= threshold)
    return {(f"h{a:06d}", f"h{b:06d}") for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}


@pytest.mark.parametrize("threshold,m,hot", [(10, 4, 4096), (10, 4, 8)])
def test_probing_finds_all_pairs(spark, threshold, m, hot):
    words = hashes(np.random.default_rng(threshold), 300, 2, threshold + 3)
    reps = spark.createDataFrame([(f"h{k:06d}", [w]) for k, w in enumerate(words)], "rep string, phash array<long>")
    bands = probing._bands(64, m, threshold)
    assert sum(n for _, n in bands.edges) == 64 and 2 * bands.flips >= threshold // m
    got = probing.near_pairs(reps, similar._bit_text("phash", 64), threshold, ["phash"], bands, hot=hot)
    rows = [(r.a, r.b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(words, threshold)
    linked = graph.components(probing.near_pairs(reps, similar._bit_text("phash", 64), threshold, ["phash"], bands, forest=True, hot=hot), "a", "b")
    assert {tuple(r) for r in linked.collect()} == {tuple(r) for r in graph.components(tiles.near_pairs(reps, threshold, ["phash"]), "a", "b").collect()}


def test_probing_compares_a_small_part_of_all_cells():
    rng = np.random.default_rng(1)
    words = rng.integers(-(2**63), 2**63 - 1, 40_000).view(np.uint64)
    bands = probing._bands(64, 4, 10)
    met = 0
    for start, length in bands.edges:
        value = (words >> np.uint64(64 - start - length)) & np.uint64((1 << length) - 1)
        keys = np.concatenate([value, *(value ^ np.uint64(1 << b) for b in range(length))])
        met += sum(int(c) * (int(c) - 1) // 2 for c in np.unique(keys, return_counts=True)[1])
    assert met < 0.1 * len(words) ** 2 / 2
    assert probing.plan(40_000, 64, 5) and probing.plan(10_000_000, 64, 10) and probing.plan(10_000_000, 64, 10).flips and probing.plan(500, 64, 10) is None


# --- words ---------------------------------------------------------------------------------------


def test_many_words_at_once(spark):
    words = ["copy", "cop", "copying", "temp", "a.b", "نسخة"]
    assert all(re.fullmatch(matching.pattern(words), w) for w in words) and not re.fullmatch(matching.pattern(words), "axb")
    df = spark.createDataFrame([("copy copying xcopy cop9 temp12 a.b",), ("",), (None,)], "t string")
    got = df.select(
        matching.whole_words(F.col("t"), words, "a-z").alias("w"), matching.marked_words(F.col("t"), words, "0-9a-z").alias("m"), matching.anywhere(F.col("t"), ["copy", "copying", "py"]).alias("a"),
    ).collect()
    assert got[0].w == ["copy", "copying", "cop", "temp", "a.b"]  # digits part words here, and a letter behind them is another word
    assert got[0].m == ["copy", "copying", "cop", "temp", "a.b"]
    assert got[0].a == ["copy", "py", "copying", "py", "copy", "py"]
    assert got[1].w == [] and got[2].w is None
    picked = df.select(matching.least(matching.anywhere(F.col("t"), words), {"copy": 3, "temp": 2}).alias("v"), matching.any_of(matching.anywhere(F.col("t"), words), ["temp"]).alias("o"))
    assert [tuple(r) for r in picked.collect()] == [(2, True), (None, False), (None, None)]


# --- ledger --------------------------------------------------------------------------------------


def test_ledger_shows_finished_runs_alone(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    assert ledger.runs(spark, root).count() == ledger.moves(spark, root).count() == ledger.undo_items(spark, root, "images").count() == 0
    rows = spark.createDataFrame([("/a", "/bin/a", "moved", 5, "x"), ("/b", None, "failed", 7, "x"), ("/c", "/bin/c", "moved", None, "x")], "original string, destination string, outcome string, size long, more string")
    when = datetime(2024, 1, 1)
    kept = dict(operation="duplicates", bin_path="/bin", started=when, finished=when)
    ledger.append(rows, root, section="images", run="r1", dry_run=False, **kept)
    ledger.append(rows.limit(0), root, section="images", run="r0", dry_run=False, **kept)
    ledger.append(rows, root, section="video", run="r2", dry_run=True, **kept)
    ledger.append(rows.limit(1), root, section="images", run="r1", dry_run=False, **kept)  # there already
    # a run that died left rows, but no row of its own
    rows.write.parquet(f"{root}/moves/section=images/run=dead")
    got = {r.run: (r.files, r.moved, r.failed, r.skipped, r.moved_bytes) for r in ledger.runs(spark, root).collect()}
    assert got == {"r1": (3, 2, 1, 0, 5), "r0": (0, 0, 0, 0, 0), "r2": (3, 2, 1, 0, 5)}
    assert {(r.run, r.original) for r in ledger.moves(spark, root).collect()} == {(r, o) for r in ("r1", "r2") for o in ("/a", "/b", "/c")}
    undo = ledger.undo_items(spark, root, "images", "duplicates")
    assert {(r.original, r.reported, r.size) for r in undo.collect()} == {("/a", "/bin/a", 5), ("/c", "/bin/c", None)}
    assert re.search(r"PartitionFilters: \[.*section.* = images", plan_of(undo))
    assert {(r.section, r.run) for r in ledger.latest(spark, root).collect()} == {("images", "r1"), ("video", "r2")}


# --- journal -------------------------------------------------------------------------------------


def library_of(folder, n):
    folder.mkdir(parents=True)
    for k in range(n):
        (folder / f"f{k}.bin").write_bytes(bytes([k % 251]) * (k + 1))


def test_journal_goes_on_after_a_run_that_died(spark, tmp_path):
    library_of(tmp_path / "lib", 60)
    rows = [(f"{tmp_path}/lib/f{k}.bin", f"{tmp_path}/bin/x/{k % 20}.bin", k + 1) for k in range(60)]
    plan = spark.createDataFrame(rows + rows[:3], "original string, destination string, size long")
    place = journal.begin(plan, f"file://{tmp_path}/journal", "r1")
    assert journal.begin(plan.limit(1), f"{tmp_path}/journal", "r1") == place and journal.intents(spark, place).count() == 60
    flag = tmp_path / "died"

    def die(_id, count=[0]):  # noqa: B006  counts inside one worker
        count[0] += 1
        if count[0] == 7 and not flag.exists():
            flag.write_text("x")
            os._exit(1)

    with pytest.raises(Exception):  # noqa: B017
        journal.resume(spark, place, parts=2, after=die)
    moved = list((tmp_path / "bin/x").iterdir())
    assert 0 < len(moved) < 60 and len(moved) + len(list((tmp_path / "lib").iterdir())) == 60
    logged = journal.outcomes(spark, place)
    assert 0 < logged.filter("outcome = 'moved'").count() < 60
    # what a crash between two steps leaves: moved but not logged, linked but not unlinked
    todo = [r for r in logged.filter("outcome is null").orderBy("original").collect()]
    with open(f"{place}/log/crash.jsonl", "w") as f:
        for r, both in zip(todo, (False, True), strict=False):
            target = f"{tmp_path}/bin/x/crash-{both}.bin"
            f.write('{"id": "%s", "chosen": "%s"}\n' % (r.id, target))
            os.link(r.original, target)
            if not both:
                os.unlink(r.original)
        f.write('{"id": "cut')
    done = journal.resume(spark, place, parts=3).collect()
    assert {r.outcome for r in done} == {"moved"} and not list((tmp_path / "lib").iterdir())
    places = [r.destination for r in done]
    assert len(set(places)) == 60 and all(os.path.getsize(p) == r.size for p, r in zip(places, done, strict=True))
    contents = Counter(open(p, "rb").read() for p in places)
    assert contents == Counter(bytes([k % 251]) * (k + 1) for k in range(60))
    assert len(list((tmp_path / "bin/x").iterdir())) == 60
    assert journal.resume(spark, place).filter("outcome = 'moved'").count() == 60  # nothing left, nothing changed


def test_journal_keeps_last_copies_and_restores(spark, tmp_path):
    library_of(tmp_path / "lib", 6)
    f = lambda k: f"{tmp_path}/lib/f{k}.bin"
    rows = [(f(0), f(5)), (f(1), f(0)), (f(2), f"{tmp_path}/lib/none"), (f(3), None), (f"{tmp_path}/lib/gone", None)]
    plan = spark.createDataFrame([(o, f"{tmp_path}/bin/{os.path.basename(o)}", s) for o, s in rows], "original string, destination string, survivor string")
    place = journal.begin(plan, str(tmp_path / "journal"), "r1")
    got = {os.path.basename(r.original): r.outcome for r in journal.resume(spark, place).collect()}
    assert got == {"f0.bin": "moved", "f1.bin": "skipped_error", "f2.bin": "skipped_error", "f3.bin": "moved", "gone": "gone"}
    (tmp_path / "lib/f3.bin").write_bytes(b"another file")
    back = spark.createDataFrame([(f(0), f"{tmp_path}/bin/f0.bin"), (f(3), f"{tmp_path}/bin/f3.bin"), (f(5), f"{tmp_path}/bin/none"), (f(4), f(4))], "original string, destination string")
    place = journal.begin(back, str(tmp_path / "journal"), "r2", kind="copy")
    got = {os.path.basename(r.original): (r.outcome, r.destination and os.path.basename(r.destination)) for r in journal.resume(spark, place).collect()}
    assert got == {"f0.bin": ("restored", "f0.bin"), "f3.bin": ("restored", "f3_restored.bin"), "f5.bin": ("missing", None), "f4.bin": ("already_there", "f4.bin")}
    assert (tmp_path / "lib/f3.bin").read_bytes() == b"another file" and (tmp_path / "bin/f0.bin").exists()
    empty = journal.begin(back.limit(0), str(tmp_path / "journal"), "r3")
    assert journal.resume(spark, empty).count() == 0


def test_journal_copies_where_links_do_not_work(tmp_path, monkeypatch):
    import errno

    def no_link(*_):
        raise OSError(errno.EXDEV, "other device")

    monkeypatch.setattr(os, "link", no_link)
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode() * 9)
    notes = []
    args = (9, None, False)
    assert journal._moved(str(tmp_path / "a"), str(tmp_path / "t/x.bin"), *args, [], notes.append, False) == ("moved", str(tmp_path / "t/x.bin"))
    assert journal._moved(str(tmp_path / "b"), str(tmp_path / "t/x.bin"), *args, [], notes.append, False) == ("moved", str(tmp_path / "t/x_1.bin"))
    assert notes == [str(tmp_path / "t/x.bin"), str(tmp_path / "t/x_1.bin")] and sorted(os.listdir(tmp_path)) == ["t"] and sorted(os.listdir(tmp_path / "t")) == ["x.bin", "x_1.bin"]
    # died after the copy was put there; died with only the place kept
    (tmp_path / "a").write_bytes(b"a" * 9)
    assert journal._moved(str(tmp_path / "a"), "unused", *args, [str(tmp_path / "t/x.bin")], notes.append, False) == ("moved", str(tmp_path / "t/x.bin"))
    (tmp_path / "c").write_bytes(b"c" * 9)
    (tmp_path / "t/y.bin").write_bytes(b"")
    assert journal._moved(str(tmp_path / "c"), str(tmp_path / "t/y.bin"), *args, [str(tmp_path / "t/y.bin")], notes.append, False) == ("moved", str(tmp_path / "t/y.bin"))
    assert not (tmp_path / "c").exists() and (tmp_path / "t/y.bin").read_bytes() == b"c" * 9


def test_two_attempts_of_one_move_leave_one_file(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"a" * 9)
    source, wanted = str(tmp_path / "a"), str(tmp_path / "t/a")
    link = os.link

    def beside(src, dst):
        """While this attempt links the file, another moves it."""
        monkeypatch.setattr(os, "link", link)
        link(src, dst)
        assert journal._moved(source, wanted, 9, None, False, [], lambda _: None, False) == ("moved", wanted)

    monkeypatch.setattr(os, "link", beside)
    assert journal._moved(source, wanted, 9, None, False, [], lambda _: None, False) == ("moved", wanted)
    assert [p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()] == [b"a" * 9]
    (tmp_path / "b").write_bytes(b"b" * 9)
    (tmp_path / "t").mkdir(exist_ok=True)
    os.link(tmp_path / "b", tmp_path / "t/b")  # linked, and not yet unlinked
    assert journal._moved(str(tmp_path / "b"), str(tmp_path / "t/b"), 9, None, False, [], lambda _: None, False) == ("moved", str(tmp_path / "t/b"))
    assert not (tmp_path / "b").exists() and (tmp_path / "t/b").read_bytes() == b"b" * 9


def test_one_driver_at_a_time(tmp_path):
    place = str(tmp_path)
    with journal.lease(place, 5), pytest.raises(journal.Held), journal.lease(place, 5):
        pass
    (tmp_path / "lease").write_text("dead")
    os.utime(tmp_path / "lease", (time.time() - 100, time.time() - 100))
    with journal.lease(place, 5):
        assert (tmp_path / "lease").read_text() != "dead"
    assert not (tmp_path / "lease").exists()
    with pytest.raises(ValueError):
        journal._local("s3://bucket/x")


# --- bin index -----------------------------------------------------------------------------------


def test_bin_index_is_read_where_it_lies(spark, tmp_path):
    rows = [(f"/bin/{k % 9}/n{k % 40}{'_1' if k % 5 == 0 else ''}.jpg", f"n{k % 40}{'_1' if k % 5 == 0 else ''}.jpg", k % 7) for k in range(400)]
    rows = list({r[0]: r for r in rows}.values())
    in_bin = spark.createDataFrame(rows, "path string, name string, size long")
    removed = spark.createDataFrame([(f"/lib/n{k}.jpg", f"/bin/{k % 9}/n{k}{'_1' if k % 3 == 0 else ''}.jpg", k % 7) for k in range(60)], "original string, reported string, size long")
    index = bin_index.BinIndex(spark, f"file://{tmp_path}/index", "bin_index_test", buckets=4)
    assert index.located(removed).filter("status <> 'missing'").count() == 0
    index.add(in_bin.filter("size % 2 = 0"))
    index.add(in_bin.filter("size % 2 = 1 or size = 4"))
    want = {tuple(r) for r in located(removed, in_bin).select("original", "actual", "status").collect()}
    found = index.located(removed)
    assert {tuple(r) for r in found.select("original", "actual", "status").collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tree = plan_of(index.located(removed), "simple").splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    scans = [k for k, line in enumerate(tree) if "FileScan parquet" in line and "bin_index_test" in line]
    assert scans
    for k in scans:  # from the scan up to the join: no line of a lesser depth is an exchange before the join
        depth = len(re.match(r"[ :+-]*", tree[k])[0])
        for line in reversed(tree[:k]):
            here = len(re.match(r"[ :+-]*", line)[0])
            if here < depth:
                depth = here
                assert "Exchange" not in line
                if "Join" in line:
                    break
    index.drop_gone(in_bin.filter("size = 4"))
    assert index.keys().select("_size").distinct().collect()[0][0] == 4
    with pytest.raises(ValueError):
        bin_index.BinIndex(spark, "x", "bad name")


# --- reports that tasks write --------------------------------------------------------------------


def test_reports_are_written_by_tasks_and_read_back(spark, tmp_path):
    from shelfloom import report
    from shelfloom.actions import Move

    rows = []
    for g in range(7):
        for k in range(3):
            path = f"/lib/{g}/f{k}.jpg"
            rows.append((f"g{g}", path, k == 1, "criterion_decided" if g % 2 else "tie", "date", f"/bin/{g}-{k}.jpg" if k != 1 else None, 10, 20, "2020-01-02 03:04:05", g % 3 == 0))
    rows.append((None, "/lib/none", True, "tie", None, None, None, None, None, None))
    ledger_rows = spark.createDataFrame(rows, "grp string, path string, is_kept boolean, reason string, criterion string, moved string, width int, height int, extracted_date string, date_only boolean")
    lines = report.rendered(ledger_rows, "similar")
    folder = str(tmp_path / "reports")
    done = report.write_rendered(lines, "similar", folder, "similar_images_deletion", dry_run=False, bin_path="/bin").collect()
    assert [r.report for r in done] == [0] and os.listdir(folder) == ["similar_images_deletion_000000.txt"]
    # the same groups by the rendering of a few groups on the driver
    groups = [{"kept": f"/lib/{g}/f1.jpg", "reason": "criterion_decided" if g % 2 else "tie", "criterion": "date", "losers": [(f"/lib/{g}/f{k}.jpg", "criterion_decided" if g % 2 else "tie") for k in (0, 2)]} for g in range(7)]
    moves = [Move(f"/lib/{g}/f{k}.jpg", f"/bin/{g}-{k}.jpg", "moved") for g in range(7) for k in (0, 2)]
    infos = {r[1]: {"width": 10, "height": 20, "extracted_date": "2020-01-02 03:04:05", "date_only": r[9]} for r in rows if r[0]}
    text = report.render("similar", groups, moves, infos, dry_run=False, bin_path="/bin")
    clean = lambda t: [x.replace("Decided by date", "Decided by") for x in t.split("=" * 60 + "\n")[2].replace("Decided by None", "Decided by").splitlines() if x.strip()]
    assert clean(open(done[0].path, encoding="utf-8").read()) == clean(text)
    assert {(r.original, r.reported) for r in report.parse(spark, [folder]).collect()} == {(m.original, m.destination) for m in moves}
    assert report.write_rendered(report.rendered(ledger_rows.limit(0), "similar"), "similar", folder, "x", dry_run=True, bin_path="/b").count() == 0


def test_thresholds_of_columns_are_those_of_numbers(spark):
    from shelfloom.config import scaled_threshold
    from shelfloom.functions.hashing import threshold_of

    rows = [(b, s) for b in range(0, 24) for s in (8, 10, 12, 16)]
    got = spark.createDataFrame(rows, "b int, s int").withColumn("t", threshold_of(F.col("b"), F.col("s"))).collect()
    assert all(r.t == scaled_threshold(r.b, r.s) for r in got) and len(got) == len(rows)


# --- pictures that are too large for a row -------------------------------------------------------


def test_a_large_picture_is_not_corrupt(spark, tmp_path):
    import struct

    from shelfloom.functions import images

    bmp = b"BM" + struct.pack("<IHHI", 54 + 12 * 3, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bytes(range(64))
    (tmp_path / "small.bmp").write_bytes(bmp)
    for name, data in (("large.bmp", bmp), ("noise.bmp", b"noise" * 30)):
        with open(tmp_path / name, "wb") as f:
            f.write(data)
            if name == "large.bmp":
                f.truncate(files.BIG + 1)  # a sparse file
    found = files.files(spark, [str(tmp_path)], [".bmp"])
    media = images.media(files.with_content(found))
    got = {os.path.basename(r.path): (r.verdict, r.width) for r in media.collect()}
    assert got == {"small.bmp": ("ok", 2), "large.bmp": ("unsupported", 2), "noise.bmp": ("corrupt", None)}


# --- a whole run ---------------------------------------------------------------------------------


def test_a_run_and_its_undoing(spark, tmp_path):
    from shelfloom import flows, runs

    lib = tmp_path / "lib"
    for k in range(12):
        (lib / f"d{k % 3}").mkdir(parents=True, exist_ok=True)
        (lib / f"d{k % 3}" / f"note_{k}.txt").write_bytes(b"%d" % (k % 4) * 2000)
    scan = Filters(min_size_bytes=10)
    decided = flows.exact_ledger(spark, [str(lib)], "other", extensions=[".txt"], scan=scan)
    assert decided.filter("is_kept").count() == 4 and decided.count() == 12
    state, keep = f"{tmp_path}/state", dict(section="other", operation="duplicates", bin_root=f"{tmp_path}/bin", home=str(tmp_path))
    dry = runs.carry_out(decided, state, run="r0", **keep)
    assert {r.outcome for r in dry.collect()} == {"dry_run"} and len(list(lib.rglob("*.txt"))) == 12
    done = runs.carry_out(decided, state, run="r1", dry_run=False, **keep).collect()
    assert Counter(r.outcome for r in done) == {"moved": 8} and len(list(lib.rglob("*.txt"))) == 4
    assert all(os.path.exists(r.destination) and not os.path.exists(r.original) and r.reason is None or r.reason for r in done)
    # the same run again changes nothing
    again = runs.carry_out(decided, state, run="r1", dry_run=False, **keep).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, done))
    assert [(r.run, r.moved, r.dry_run) for r in ledger.runs(spark, f"{state}/ledger").orderBy("run").collect()] == [("r0", 0, True), ("r1", 8, False)]
    first = done[0]
    os.unlink(done[1].destination)
    os.makedirs(os.path.dirname(first.original), exist_ok=True)
    with open(first.original, "wb") as f:
        f.write(b"another file")
    would = runs.undo(spark, state, run="u0", section="other")
    assert Counter(r.outcome for r in would.collect()) == {"would_restore": 8}
    back = {r.original: (r.outcome, r.destination) for r in runs.undo(spark, state, run="u1", section="other", dry_run=False).collect()}
    assert Counter(o for o, _ in back.values()) == {"restored": 7, "missing": 1} and back[done[1].original][0] == "missing"
    assert back[first.original][1].endswith("_restored.txt") and open(first.original, "rb").read() == b"another file"
    assert len(list(lib.rglob("*.txt"))) == 4 + 7 + 1
