"""Naming, date and scoring rules against their tables of expected values."""

import pytest
from pyspark.sql import functions as F

from shelfloom import catalog
from shelfloom.config import Priorities, scaled_threshold
from shelfloom.functions import dates, names
from shelfloom.operators import quality, scoring, selection

IMPORTANCE = {
    "photo_holiday.jpg": 8, "WhatsApp_2024.jpg": 7, "DSC_0453.jpg": 9, "original.jpg": 9, "epic_sunset.jpg": 6, "Temple_run.jpg": 6,
    "screenshot.png": 7, "thumbnail_001.jpg": 5, "img_1080x2340x24_020414.jpg": 6, "photo (2024-01-01).jpg": 8, "photo (10).jpg": 3,
    "photo (1).jpg": 3, "copy (1).jpg": 2, "dsc (2).jpg": 2, "recovered_file.jpg": 2, "image - copy.jpg": 3, "photo_copy.jpg": 4,
    "photo (\u00a03\u2003).jpg": 3, "photo (\u06f3).jpg": 3, "backup_photo.jpg": 4, "temp.jpg": 4, "dsc (Final).jpg": 9, "photo (2024).jpg": 3, "photo (١٠).jpg": 3,
}
PROVENANCE = {
    "IMG_20181117_142355.jpg": 4, "photo_20150601.jpg": 4, "Screenshot_20220712.png": 4, "IMG_1234_WA0001.jpg": 4, "20131213_161353.jpg": 3,
    "Movie (2018).jpg": 3, "David.jpg": 3, "Temple_run.jpg": 3, "video_backup.mp4": 2, "edited_final.jpg": 2, "20131213_161353 (1).jpg": 1,
    "photo (99999999).jpg": 1, "my copy.jpg": 1, "copy2.jpg": 1, "Recovered_jpg_file(1082).jpg": 0, "restored_photo.jpg": 0, "img_1280x853x24_001092.jpg": 0,
}
DATES = {
    "20131213_161353 (1).jpg": "2013-12-13 16:13:53", "IMG_20231004_104853_036.jpg": "2023-10-04 10:48:53", "2022-07-12_21-49-09.png": "2022-07-12 21:49:09",
    "20131213161353.jpg": "2013-12-13 16:13:53", "IMG-20181019-WA0058.jpg": "2018-10-19 00:00:00", "20180817_996060.jpg": "2018-08-17 00:00:00",
    "20189999_123456.jpg": None, "12345678.jpg": None, "-5868218734718597913_121.jpg": None, "13-12-2013_16-13-53.jpg": "2013-12-13 16:13:53",
    "13122013_161353.jpg": "2013-12-13 16:13:53", "٢٠١٣١٢١٣_١٦١٣٥٣.jpg": "2013-12-13 16:13:53", "no date.jpg": None,
}


def over_names(spark, values, expr):
    df = spark.createDataFrame([(n,) for n in values], "name string")
    return {r.name: r.v for r in df.select("name", expr.alias("v")).collect()}


def test_importance(spark):
    assert over_names(spark, IMPORTANCE, names.importance(F.col("name"))) == IMPORTANCE


def test_provenance(spark):
    assert over_names(spark, PROVENANCE, names.provenance(F.col("name"))) == PROVENANCE
    name = F.col("name")
    got = over_names(spark, ["20180817.mp4", "img_1x1x24_1.mp4", "clip (2).mp4", "screenshot.mp4", "[20180817].mp4", "2018-08-17.mp4", None], names.video_provenance(name, dates.filename_timestamp(name)))
    assert got == {"20180817.mp4": 4, "img_1x1x24_1.mp4": 4, "clip (2).mp4": 1, "screenshot.mp4": 3, "[20180817].mp4": 3, "2018-08-17.mp4": 4, None: None}
    both = spark.createDataFrame([(n,) for n in [*PROVENANCE, *IMPORTANCE, None]], "name string")
    for r in names.evidence(both.withColumn("want", names.importance(name)).withColumn("cls", names.provenance(name)), "name", dates.filename_timestamp(name)).collect():
        assert (r.importance, r.provenance) == (r.want, r.cls)


def test_dates(spark):
    assert over_names(spark, DATES, F.date_format(dates.filename_timestamp(F.col("name")), "yyyy-MM-dd HH:mm:ss")) == DATES


def test_name_parts(spark):
    values = [".bashrc", "a.tar.gz", "x", "x_3.jpg", "_3.jpg", None]
    assert over_names(spark, values, names.suffix(F.col("name"))) == {".bashrc": "", "a.tar.gz": ".gz", "x": "", "x_3.jpg": ".jpg", "_3.jpg": ".jpg", None: None}
    plain = over_names(spark, [*values, "x_3", "a.b_2", "photo (2)_3.jpg", "x_.jpg", "x_٣.jpg"], names.strip_collision(F.col("name")))
    assert plain == {".bashrc": ".bashrc", "a.tar.gz": "a.tar.gz", "x": "x", "x_3.jpg": "x.jpg", "_3.jpg": "_3.jpg", None: None, "x_3": "x_3", "a.b_2": "a.b_2", "photo (2)_3.jpg": "photo (2).jpg", "x_.jpg": "x_.jpg", "x_٣.jpg": "x.jpg"}
    assert over_names(spark, ["/d/My Copy.jpg", "/copy/x.jpg", None], names.names_recovery(F.col("name"))) == {"/d/My Copy.jpg": True, "/copy/x.jpg": False, None: None}
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 40,)], "n long")
    assert [r[0] for r in df.select(names.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.50 KB", "5.00 TB"]
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 30,)], "n long")
    assert [r[0] for r in df.select(names.human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB"]
    df = spark.createDataFrame([("Kept: /a:b ",), ("none",), ("x:  ",)], "t string")
    assert [r[0] for r in df.select(names.after_colon(F.col("t"))).collect()] == ["/a:b", None, None]


def test_exif_and_best_date(spark):
    df = spark.createDataFrame([({"DateTime": "2020:01:02 03:04:05", "DateTimeOriginal": "bad"},), ({},), (None,)], "tags map<string,string>")
    got = [str(r[0]) for r in df.select(dates.exif_timestamp(F.col("tags"))).collect()]
    assert got == ["2020-01-02 03:04:05", "None", "None"]
    ts = lambda t: F.lit(t).cast("timestamp_ntz")
    cases = [("2020-01-01", "2020-01-01", True), ("2020-01-02", "2020-01-01", True), ("2020-01-02", "2020-01-01", False), (None, "2020-01-01", True), ("2020-01-01", None, True), (None, None, True)]
    row = spark.range(1).select(*[dates.best_date(ts(a), ts(b), oldest=o)["source"].alias(f"c{k}") for k, (a, b, o) in enumerate(cases)]).first()
    assert list(row) == ["filename", "exif", "filename", "exif", "filename", "none"]
    assert spark.range(1).select(dates.compare_dates(ts("2020-01-01"), ts(None)), dates.compare_dates(ts(None), ts(None))).first()[:] == (-1, 0)


def scores(spark, groups, kind, expr):
    rows = [(g, k, *v) if isinstance(v, tuple) else (g, k, v) for g, vs in enumerate(groups) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, f"grp int, k int, {kind}")
    out = [[] for _ in groups]
    for r in sorted(df.withColumn("s", expr).collect(), key=lambda r: (r.grp, r.k)):
        out[r.grp].append(None if r.s is None else round(r.s, 3))
    return out


def test_ratio_and_filename_scores(spark):
    groups = [[7.76, 7.77], [1.0, 4.0], [0.0, 1.0, 2.0], [None, 3.0], [1.0, 2.0, 4.0]]
    of = scoring.Aggregates()
    df = spark.createDataFrame([(g, k, v) for g, vs in enumerate(groups) for k, v in enumerate(vs)], "grp int, k int, v double")
    joined = {(r.grp, r.k): r.s for r in of.scored(df, {"s": scoring.ratio_scores(F.col("v"), of)}).collect()}
    assert [[joined[g, k] for k in range(len(vs))] for g, vs in enumerate(groups)] == [[5, 5], [0, 10], [0, 0, 10], [5, 5], [0, 5, 10]]
    assert scores(spark, groups, "v double", scoring.ratio_scores(F.col("v"))) == [[5, 5], [0, 10], [0, 0, 10], [5, 5], [0, 5, 10]]
    assert scores(spark, [[8, 2], [3, 3]], "v int", scoring.filename_scores(F.col("v"))) == [[8.889, 2.222], [5, 5]]
    assert scores(spark, [[10_000, 40_000], [10_000, 15_000], [1, 1 << 40]], "v long", scoring.resolution_boost(F.col("v"))) == [[2, 2], [1, 1], [3, 3]]
    row = spark.range(1).select(scoring.gate_passes(F.lit(1.0), F.lit(1.049)), scoring.gate_passes(F.lit(1.0), F.lit(1.05)), scoring.gate_passes(F.lit(0.0), F.lit(1.0))).first()
    assert list(row) == [False, True, True]


def test_date_scores(spark):
    groups = [
        [("2016-09-15 00:00:00", "filename"), ("2016-09-15 18:44:05", "exif")],
        [("2018-10-19 00:00:00", "filename"), ("2018-11-17 00:00:00", "filename")],
        [("2018-10-19 08:00:00", "exif"), ("2018-11-17 09:00:00", "exif"), ("2018-11-17 00:00:00", "filename")],
        [("2018-10-19 08:00:00", "exif"), ("2018-10-19 08:00:01", "exif"), (None, "none")],
        [("2018-10-19 08:00:00", "exif"), (None, "none")],
        [(None, "none"), (None, "none")],
        [("2018-10-19 08:00:00", "exif"), ("2019-10-19 08:00:01", "exif"), (None, "none")],
    ]
    kind = "t string, src string"
    got = scores(spark, groups, kind, scoring.date_scores(F.col("t").cast("timestamp_ntz"), F.col("src")))
    assert got == [[5, 5], [10, 0], [10, 0, 0], [5, 5, 5], [10, 3], [5, 5], [10, 0, 3]]
    span = scores(spark, [[("2018-06-17 00:00:00", "filename"), ("2018-07-07 00:00:00", "filename")]], kind, scoring.date_span_seconds(F.col("t").cast("timestamp_ntz"), F.col("src")))
    assert span == [[1_728_000, 1_728_000]]


def survivor(spark, files, priorities=Priorities()):
    df = spark.createDataFrame([("g", n, n, px, sz) for n, px, sz in files], "grp string, path string, name string, pixels long, size long")
    ts = dates.filename_timestamp(F.col("name"))
    df = df.withColumns({"importance": names.importance(F.col("name")), "provenance": names.provenance(F.col("name")), "ts": ts, "ts_source": F.when(ts.isNotNull(), "filename").otherwise("none")})
    return selection.ranked(df, priorities).filter("rank = 1").first().path


@pytest.mark.parametrize(
    "files,gap,want",
    [
        (["IMG-20180617-WA0051 (2).jpg", "IMG-20180707-WA0042.jpg"], 24, 0),
        (["IMG-20180617-WA0051 (2).jpg", "IMG-20180707-WA0042.jpg"], 100_000, 1),
        (["20131213_161353 (1).jpg", "20131213_181353.jpg"], 24, 1),
        (["20131213_161353 (1).jpg", "20131213_181353.jpg"], 0, 0),
        (["recovered_20100101.jpg", "IMG-20190815-WA0136.jpg"], 24, 1),
        (["IMG_20200101_120000.jpg", "٢٠١٠٠١٠١.jpg"], 24, 1),
    ],
)
def test_survivors(spark, files, gap, want):
    assert survivor(spark, [(n, 100, 100) for n in files], Priorities(gate_gap_hours=gap)) == files[want]


def test_totals_of_a_resolution_contest(spark):
    rows = [("g", "a", "a", 360 * 449, 1, 5, None, "none"), ("g", "b", "b", 720 * 897, 1, 5, None, "none")]
    df = spark.createDataFrame(rows, "grp string, path string, name string, pixels long, size long, importance int, ts timestamp_ntz, ts_source string")
    got = {r.path: round(r.total, 1) for r in scoring.score_table(df).collect()}
    assert got["a"] == 35 and got["b"] == pytest.approx(95, abs=0.1)  # 35 + 10 * 3 * boost 2


def test_settings_and_catalogue():
    assert Priorities().weights == {"resolution": 3, "size": 2, "date": 4, "filename": 1} == Priorities(order=(1, 1, 1, 1)).weights
    assert [scaled_threshold(5, s) for s in (8, 10, 12, 16)] == [5, 8, 11, 20] and scaled_threshold(0, 8) == 5
    assert catalog.normalise_extensions(" .PDF, docx;;jpg|tar.gz  .x!y toolongextension pdf") == [".pdf", ".docx", ".jpg", ".tar.gz"]
    assert len(catalog.IMAGE) == 23 and len(catalog.all_extensions(catalog.OFFICE)) == 45 and len(catalog.all_extensions(catalog.VIDEO)) == 24
    assert catalog.section_of(".mkv") == "video" and catalog.section_of(".weird") == "other"
    cases = {"800x600": (800, 600), "width=5 height=7": (5, 7), "height=7, width=5": (5, 7), "300": (300, 300), "1,2,3": (1, 2), "0x5": None, "": None}
    assert {k: quality.parse_dimensions(k) for k in cases} == cases


def test_selection_of_odd_rows(spark):
    """Null groups and evidence, repeated rows, ties, groups of one, no rows."""
    ts = None
    rows = [(None, "n/1", "a", None, None, None, None, ts, None), (None, "n/2", "b", 5, 5, 5, 3, ts, None), ("t", "t/B", "B", 1, 1, 5, 3, ts, "none"), ("t", "t/b", "b", 1, 1, 5, 3, ts, "none"),
            ("t", "t/b", "b", 1, 1, 5, 3, ts, "none"), ("o", "o/1", "x", 1, 1, 5, 3, ts, "none")]
    df = spark.createDataFrame(rows, "grp string, path string, name string, pixels long, size long, importance int, provenance int, ts timestamp_ntz, ts_source string").withColumn("mtime", F.col("ts"))
    got = sorted((r.path, r.rank) for r in selection.ranked(df).collect())
    assert got == [("n/1", 1), ("n/2", 2), ("o/1", 1), ("t/B", 1), ("t/b", 2), ("t/b", 2)]
    assert sorted(r.path for r in selection.survivors(df).collect()) == ["n/1", "o/1", "t/B"]
    assert selection.ranked_videos(df).count() == 6 and selection.explained(selection.ranked(df)).count() == 2
    assert selection.ranked(df.limit(0)).count() == 0 == selection.explained(selection.ranked(df.limit(0))).count()
    assert dates.stored_date is not None and [r[0] is None for r in spark.createDataFrame([("2020-01-02 03:04:05 (exif)",), ("Unknown",), (None,)], "t string").select(dates.stored_date(F.col("t"))).collect()] == [False, True, True]
