"""Queries over the driver's tables, with the SQL of each that SQL expresses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom import flows
from shelfloom.actions import destinations, located
from shelfloom.config import DEFAULT_FILTERS, Filters, Priorities
from shelfloom.functions import dates, names
from shelfloom.functions.hashing import full_hash, hamming, similarity_pct
from shelfloom.operators import dedup, filters, quality, selection, similar
from shelfloom.operators.ranking import per_group
from shelfloom.plans import storage
from shelfloom.plans.library import FILES_SQL, HASHES_SQL, files, hashes
from shelfloom.runtime import table

THRESHOLD = 20
THRESHOLD_BOTH = 22
SAMPLE = 64
SCAN = Filters(max_size_mb=0, excluded_patterns=DEFAULT_FILTERS.excluded_patterns)


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups for the selection queries: files of one language and length
    class, with all evidence."""
    return _evidence(files(spark, sf_dir).drop("content", "text")).select(
        F.expr("substring(ext, 2) || '-' || CAST(doc_id % 97 AS STRING)").alias("grp"),
        "path", "name", "pixels", "size", "mtime", "importance", "provenance", "video_provenance", "name_ts",
        F.col("best.ts").alias("ts"), F.col("best.source").alias("ts_source"),
    )


def _evidence(rows: DataFrame) -> DataFrame:
    """What selection asks of a name and a time, step by step."""
    rows = rows.withColumn("name_ts", dates.filename_timestamp(F.col("name")))
    rows = names.evidence(rows, "name", F.col("name_ts"))
    return rows.withColumn("best", dates.best_date(F.col("name_ts"), F.lit(None).cast("timestamp_ntz"), F.col("mtime")))


def _content(s, d):
    return files(s, d).select("path", "ext", "size", "content")


def exact_dup_groups(s, d):
    return dedup.duplicate_groups(_content(s, d))


def exact_dup_members(s, d):
    """Which file is in which group: the groups as a table, not as lists."""
    return dedup.duplicate_rows(_content(s, d)).select("ext", "sha256", "path")


def exact_dup_images_style(s, d):
    return dedup.duplicate_groups(_content(s, d), by_extension=False)


def exact_dup_images_members(s, d):
    return dedup.duplicate_rows(_content(s, d), by_extension=False).select("sha256", "path")


def exact_dup_totals(s, d):
    return dedup.totals(dedup.duplicate_groups(_content(s, d)))


def exact_dup_survivors(s, d):
    f = files(s, d)
    rows = dedup.duplicate_rows(f.select("path", "name", "ext", "size", "mtime", "pixels", "content"))
    rows = _evidence(rows).select(
        F.concat_ws("-", "ext", "sha256").alias("grp"), "path", "name", "pixels", "size", "importance", "provenance",
        F.col("best.ts").alias("ts"), F.col("best.source").alias("ts_source"),
    )
    return selection.ledger(selection.ranked(rows)).select("grp", "path", "tier", F.round("total", 6).alias("total"), "is_kept")


def size_candidates(s, d):
    return dedup.size_candidates(files(s, d).select("path", "ext", "size"))


def sample_stats(s, d):
    return dedup.sample_stats(files(s, d).select("path", "ext", "size", "content"), SAMPLE)


def skip_reasons(s, d):
    return filters.scanned(files(s, d).select("path", "name", "ext", "size"), filters=SCAN).select("path", "skip_reason")


def skip_summary(s, d):
    return filters.skip_summary(filters.scanned(files(s, d).select("path", "name", "ext", "size"), filters=SCAN))


def kept_files(s, d):
    scanned = filters.scanned(files(s, d).select("path", "name", "ext", "size"), [".en", ".de"], SCAN)
    return filters.kept(scanned).select("path", "size")


def _named(s, d):
    return files(s, d).select("path", "name")


def name_importance(s, d):
    return names.evidence(_named(s, d)).select("path", "importance")


def name_provenance(s, d):
    return names.evidence(_named(s, d), "name", dates.filename_timestamp(F.col("name"))).select("path", "provenance", "video_provenance")


def filename_dates(s, d):
    return files(s, d).select("path", F.date_format(dates.filename_timestamp(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


def name_parts(s, d):
    n = F.col("name")
    return files(s, d).select("path", names.stem(n).alias("stem"), names.suffix(n).alias("suffix"), names.base_name(F.col("path")).alias("base"), names.strip_collision(n).alias("plain"))


def name_marks(s, d):
    """Recovery words anywhere in the name, and both forms of a size."""
    size = F.expr("size * size * 7")
    return files(s, d).select("path", names.names_recovery(F.col("path")).alias("recovery"), names.human_bytes(size).alias("bytes"), names.human_size(size).alias("short"))


def file_info(s, d):
    """Every file with what is known of it; each fourth has no header."""
    f = files(s, d)
    media = f.filter("doc_id % 4 <> 0").select(
        "path", (F.col("pixels") / 1000).cast("int").alias("width"), F.lit(1000).alias("height"), F.lit("PNG").alias("format"), F.lit("RGB").alias("mode"),
        F.when(F.expr("doc_id % 3 = 0"), F.create_map(F.lit("DateTime"), F.lit("2011:02:03 04:05:06"))).alias("exif"),
    )
    info = flows.file_info(f.select("path", "name", "size", "mtime"), media)
    return info.drop("ts", "provenance")

def best_dates(s, d):
    best = dates.best_date(dates.filename_timestamp(F.col("name")), F.when(F.col("pixels") % 3000 == 0, F.col("mtime")), F.col("mtime"))
    return files(s, d).select("path", F.date_format(best["ts"], "yyyy-MM-dd HH:mm:ss").alias("ts"), best["source"].alias("source"))


def score_table(s, d):
    from shelfloom.operators.scoring import score_table as table_of

    t = table_of(rivals(s, d))
    r = lambda c: F.round(c, 5).alias(c)
    return t.select("grp", "path", r("s_resolution"), r("s_size"), r("s_date"), r("s_filename"), r("boost"), r("total"), "date_decides")


def best_file(s, d):
    return selection.survivors(rivals(s, d)).select("grp", "path", "tier")


def _videos(s, d):
    rows = rivals(s, d).withColumn("provenance", F.col("video_provenance"))
    rows = rows.withColumn("ts_source", F.when(F.col("name_ts").isNotNull(), "filename").otherwise("modified"))
    return rows


def best_video(s, d):
    return selection.surviving_videos(_videos(s, d)).select("grp", "path", "tier")


def video_reasons(s, d):
    return selection.video_reasons(selection.ranked_videos(_videos(s, d)))


def selection_reasons(s, d):
    e = selection.explained(selection.ranked(rivals(s, d)))
    return e.select("grp", "kept", "rival", "reason", "criterion", F.round("margin", 5).alias("margin"), F.array_join("notes", "|").alias("notes"), "caveat")


def reason_details(s, d):
    """What the notes of ``selection_reasons`` are about."""
    e = selection.explained(selection.ranked(rivals(s, d)))
    return e.select("grp", "kept_class", "rival_class", F.array_join("favoured", "|").alias("favoured"), F.round("gap_hours", 5).alias("gap_hours"))


def reason_counts(s, d):
    return selection_reasons(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def deletion_reasons(s, d):
    return selection.deletion_reasons(selection.ranked(rivals(s, d)))


def resolution_sacrifice(s, d):
    return selection.resolution_sacrifice(selection.ranked(rivals(s, d)))


def replay_diff(s, d):
    return selection.replay_diff(rivals(s, d), Priorities(), Priorities(order=(1, 2, 4, 3)))


def replay_causes(s, d):
    """A recorded run that kept the first path and knew dates to the day."""
    rows = per_group(rivals(s, d), "grp", F.min("path").alias("_first")).withColumns({
        "was_kept": F.col("path") == F.col("_first"),
        "old_ts": F.date_trunc("day", "ts").cast("timestamp_ntz"),
        "old_source": F.lit("none"),
    })
    return selection.replay_causes(rows)


def replay_cause_counts(s, d):
    return replay_causes(s, d).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def replay_counts(s, d):
    return replay_diff(s, d).groupBy("changed").agg(F.count(F.lit(1)).alias("n"))


def hamming_pairs(s, d):
    """Pairs by the first hash alone."""
    return similar.hamming_pairs(hashes(s, d), THRESHOLD, secondary=False)


def hamming_pairs_both(s, d):
    """Pairs within the threshold in both hashes, the rule of the similar pass."""
    return similar.hamming_pairs(hashes(s, d), THRESHOLD_BOTH)


def similar_groups(s, d):
    return similar.similar_groups(hashes(s, d), THRESHOLD, secondary=False)


def similar_groups_both(s, d):
    return similar.similar_groups(hashes(s, d), THRESHOLD_BOTH)


def similar_totals(s, d):
    return similar.totals(similar_groups_both(s, d))


def similarity_pct_query(s, d):
    h = hashes(s, d)
    return similar.similarity_to_first(similar.similar_groups(h, THRESHOLD, secondary=False), h)


def hamming_sides(s, d):
    """Both hashes of every embedding against those of embedding 0."""
    h = hashes(s, d)
    first = h.filter(F.col("path") == "v000000").select(F.col("phash").alias("p0"), F.col("dhash").alias("d0"))
    # one row, found by its id
    both = h.join(F.broadcast(first.limit(1)), F.lit(True))
    p = hamming(F.col("phash"), F.col("p0"))
    return both.select("path", p.alias("distance"), hamming(F.col("dhash"), F.col("d0")).alias("distance2"), similarity_pct(p, 64).alias("pct"))


def small_filter(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") * 15).alias("width"), (F.col("p_partkey") % 900).cast("int").alias("height"))
    return quality.small_files(p).select("p_partkey", "reason")


def small_stats(s, d):
    p = table(s, d, "part").select((F.col("p_size") * 15).alias("width"), (F.col("p_partkey") % 900).cast("int").alias("height"), F.col("p_partkey").alias("size"))
    return quality.small_stats(quality.small_files(p))


def recycle_destinations(s, d):
    """Short names that meet, some with a number already, and some in the bin
    from before."""
    f = files(s, d).select(
        "doc_id", "path", F.expr("substring(path, 6, locate('/', path, 6) - 6)").alias("folder"),
        F.expr("substring(name, 1, 3) || CASE WHEN doc_id % 11 = 0 THEN '_' || (1 + doc_id % 4) ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN '' ELSE '.dat' END").alias("name"),
    )
    taken = f.filter("doc_id % 19 = 0").select("folder", F.expr("substring(name, 1, 3) || '_' || (doc_id % 5) || '.dat'").alias("name"))
    return destinations(f.drop("doc_id"), "/bin", "duplicates", taken.unionByName(taken.limit(0))).select("path", "destination")


def removed_and_bin(s, d):
    """What a run has removed, and what lies in the bin by now."""
    f = files(s, d).select("doc_id", "path", "name", "size")
    removed = f.select(
        F.col("path").alias("original"),
        F.expr("'/bin/' || name || CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END").alias("reported"),
        "size",
    )
    in_bin = f.filter("doc_id % 5 <> 0").select(
        F.expr("'/bin/' || CASE WHEN doc_id % 4 = 0 THEN 'x/' ELSE '' END || (doc_id % 50) || '/' || name").alias("path"), "name", "size"
    )
    in_bin = in_bin.groupBy(F.expr("CASE WHEN path LIKE '/bin/1_/%' THEN '/bin/' || name ELSE path END").alias("path"), "name").agg(F.max("size").alias("size"))
    return removed, in_bin


def restore_plan(s, d):
    return located(*removed_and_bin(s, d)).select("original", "actual", "status")


def restore_counts(s, d):
    return restore_plan(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def folder_union(s, d):
    """Two overlapping folders; a path comes once."""
    f = files(s, d).select("path", "size", "ext")
    return f.filter("ext in ('.en', '.de')").unionByName(f.filter("ext in ('.de', '.fr')")).dropDuplicates(["path"]).select("path", "size")


def unhashed(s, d):
    f = files(s, d).select("path", "size")
    return similar.unhashed(f, f.filter("size % 7 <> 0"))


def cross_volume(s, d):
    from shelfloom.actions import capacity

    f = files(s, d).select("size", F.expr("doc_id % 3").alias("device"))
    return capacity(f, 0, 1 << 30)


def content_digests(s, d):
    return files(s, d).select("path", full_hash(F.col("content")).alias("sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (
        exact_dup_groups, exact_dup_members, exact_dup_images_style, exact_dup_images_members, exact_dup_totals, exact_dup_survivors, size_candidates, sample_stats,
        skip_reasons, skip_summary, kept_files, name_importance, name_provenance, filename_dates, name_parts, name_marks, file_info, best_dates,
        score_table, best_file, best_video, video_reasons, selection_reasons, reason_details, reason_counts, deletion_reasons, resolution_sacrifice,
        replay_diff, replay_counts, replay_causes, replay_cause_counts,
        hamming_pairs, hamming_pairs_both, similar_groups, similar_groups_both, similar_totals, hamming_sides, small_filter, small_stats, recycle_destinations,
        restore_plan, restore_counts, folder_union, unhashed, cross_volume, content_digests,
    )}
    return out | {"similarity_pct": similarity_pct_query} | storage.queries()


# ---------------------------------------------------------------------------
# DuckDB SQL


def _sql_match(words: str, text: str, pattern: str) -> str:
    return f"list_contains({words}, '{pattern}')" if re.fullmatch("[a-z]+", pattern) else f"contains({text}, '{pattern}')"


def _norm(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '{names.BIDI}', '', 'g')"


def _importance_sql() -> str:
    ranked = sorted(names.IMPORTANCE, key=len, reverse=True)
    case = "CASE " + " ".join(f"WHEN {_sql_match('w', 't', p)} THEN {names.IMPORTANCE[p]}" for p in ranked) + " ELSE 5 END"
    copied = " OR ".join(["num", *[_sql_match("w", "t", p) for p in names.COPY_WORDS]])
    return f"""
a_imp AS (SELECT *, {_norm("name")} AS t FROM files),
b_imp AS (SELECT *, string_split_regex(t, '[^a-z]+') AS w, regexp_matches(t, '{names.NUMBERED}') OR regexp_matches(t, '{names.ARABIC_NUMBERED}') AS num FROM a_imp),
c_imp AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(t, '\\.[^.]*$', ''), '{names.CARVED}') THEN 5 ELSE {case} END AS b FROM b_imp),
imp AS (SELECT * EXCLUDE (t, w, num, b), CASE WHEN num THEN least(b, 3) WHEN {copied} THEN least(b, 3) + 1 ELSE b + 1 END AS importance FROM c_imp)"""


def _marker(words: str, markers: list[str]) -> str:
    return f"len(list_filter({words}, lambda x: regexp_matches(x, '^({'|'.join(markers)})[0-9]*$'))) > 0"


def _class_sql(text: str, words: str, original: list[str], image: bool) -> str:
    tests = [
        f"CASE WHEN regexp_matches({text}, '{names.NUMBERED_END}') AND NOT regexp_matches({text}, '{names.YEAR_END}') THEN 1 ELSE 3 END",
        f"CASE WHEN {_marker(words, names.RECOVERY_MARKERS)} THEN 0 ELSE 3 END",
        f"CASE WHEN {_marker(words, names.COPY_MARKERS)} THEN 1 ELSE 3 END",
        f"CASE WHEN {_marker(words, names.WEAK_MARKERS)} THEN 2 ELSE 3 END",
    ]
    if image:
        tests += [f"CASE WHEN regexp_matches({text}, '{names.ARABIC_NUMBERED}') THEN 1 ELSE 3 END", f"CASE WHEN regexp_matches({text}, '{names.CARVED}') THEN 0 ELSE 3 END"]
    worst = f"least({', '.join(tests)})"
    return f"CASE WHEN {worst} = 3 AND {_marker(words, original)} THEN 4 ELSE {worst} END"


def _plain_sql(name: str) -> str:
    """Without the number behind the last underscore before the last dot."""
    end = f"string_split({name}, '.')[-1]"
    stem = f"left({name}, len({name}) - len({end}) - 1)"
    tail = f"string_split({stem}, '_')[-1]"
    base = f"left({stem}, len({stem}) - len({tail}) - 1)"
    return f"CASE WHEN contains({name}, '.') AND contains({stem}, '_') AND {base} <> '' AND regexp_full_match({tail}, '[0-9]+') THEN {base} || '.' || {end} ELSE {name} END"


_STEM_SQL = "regexp_replace(name, '^(.+)\\.[^.]+$', '\\1')"


def _provenance_sql() -> str:
    return f"""
a_pro AS (SELECT *, {_norm(_STEM_SQL)} AS t FROM imp),
b_pro AS (SELECT *, string_split_regex(t, '{names.TOKEN_GAP}') AS w FROM a_pro),
pro AS (SELECT * EXCLUDE (t, w), {_class_sql("t", "w", names.ORIGINAL_MARKERS, True)} AS provenance,
    {_class_sql("t", "w", names.VIDEO_ORIGINAL_MARKERS, False)} AS video_plain,
    len(list_filter(w, lambda x: x <> '')) > 0 AND len(list_filter(w, lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))) = 0 AND regexp_full_match(t, '[-0-9_./ ]+') AS all_digits FROM b_pro)"""


def _dates_sql() -> str:
    """The name shapes of the library hold one date each, so first matches do."""
    t = "translate(lower(name), '٠١٢٣٤٥٦٧٨٩', '0123456789')"
    stamp = lambda e: f"try_strptime({e}, '%Y-%m-%d %H:%M:%S')"
    timed = []
    for pattern, kind, day_first in dates.TIMED:
        p = pattern.replace("(?<![0-9])", "(?:^|[^0-9])").replace("(?![0-9])", "(?:[^0-9]|$)")
        body = f"regexp_extract(t, '{p}', 0)"
        if kind == "packed":
            x = f"regexp_replace({body}, '[^0-9]', '', 'g')"
            y, m, dd = ((5, 4), (3, 2), (1, 2)) if day_first else ((1, 4), (5, 2), (7, 2))
            cut = lambda c, x=x: f"substr({x}, {c[0]}, {c[1]})"
            timed.append(stamp(f"{cut(y)} || '-' || {cut(m)} || '-' || {cut(dd)} || ' ' || {cut((9, 2))} || ':' || {cut((11, 2))} || ':' || {cut((13, 2))}"))
        else:
            x = f"regexp_extract_all({body}, '[0-9]+')"
            y, m, dd = (3, 2, 1) if day_first else (1, 2, 3)
            timed.append(stamp(f"{x}[{y}] || '-' || {x}[{m}] || '-' || {x}[{dd}] || ' ' || {x}[4] || ':' || {x}[5] || ':' || {x}[6]"))
    plain = []
    for pattern, day_first in dates.DATED:
        a, b, c = (f"regexp_extract(t, '{pattern}', {k})" for k in (1, 2, 3))
        y, m, dd = (c, b, a) if day_first else (a, b, c)
        plain.append(f"CASE WHEN {y} BETWEEN '1900' AND '2100' THEN {stamp(f'''{y} || '-' || {m} || '-' || {dd} || ' 00:00:00' ''')} END")
    ok = lambda e: f"CASE WHEN year({e}) BETWEEN 1900 AND 2100 THEN {e} END"
    return f"dat AS (SELECT * EXCLUDE (t), coalesce({', '.join([*map(ok, timed), *plain])}) AS name_ts FROM (SELECT *, {t} AS t FROM pro))"


def _evidence_sql() -> str:
    return FILES_SQL + "," + _importance_sql() + "," + _provenance_sql() + ",\n" + _dates_sql()


def _rivals_sql() -> str:
    return _evidence_sql() + """,
rivals AS (SELECT substr(ext, 2) || '-' || CAST(doc_id % 97 AS VARCHAR) AS grp, path, name, pixels, size, mtime, importance, provenance,
    coalesce(name_ts, mtime) AS ts, CASE WHEN name_ts IS NOT NULL THEN 'filename' ELSE 'modified' END AS ts_source,
    CASE WHEN video_plain = 3 AND all_digits AND name_ts IS NOT NULL THEN 4 ELSE video_plain END AS video_provenance FROM dat)"""


def _ratio(value: str, low: str, high: str, n: str) -> str:
    return f"CASE WHEN NOT ({n} >= 2 AND {high} / {low} >= 1.05) THEN 5.0 ELSE coalesce(least(10.0, greatest(0.0, 10.0 * ln({value} / {low}) / ln({high} / {low}))), 0.0) END"


def _scored_sql(priorities: Priorities = Priorities(), name: str = "scored", source: str = "rivals") -> str:
    w = priorities.weights
    pos = lambda c: f"CASE WHEN {c} > 0 THEN CAST({c} AS DOUBLE) END"
    stats = ", ".join(f"min({pos(c)}) OVER g AS {c}_lo, max({pos(c)}) OVER g AS {c}_hi, count({pos(c)}) OVER g AS {c}_n" for c in ("pixels", "size"))
    # a group of one file has no span: known = 1
    return f"""
{name}_a AS (SELECT *, {stats}, min(importance) OVER g AS i_lo, max(importance) OVER g AS i_hi, count(ts) OVER g AS known,
    max(epoch_us(ts)) OVER g - min(epoch_us(ts)) OVER g < 60000000 AS noise,
    max(CASE WHEN ts_source = 'filename' AND ts = date_trunc('day', ts) THEN 1 ELSE 0 END) OVER g = 1 AS any_day FROM {source} WINDOW g AS (PARTITION BY grp)),
{name}_b AS (SELECT *, CASE WHEN any_day THEN epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP)) / 1e6 ELSE epoch_us(ts) / 1e6 END AS used FROM {name}_a),
{name}_c AS (SELECT *, min(used) OVER (PARTITION BY grp) AS d_lo, max(used) OVER (PARTITION BY grp) AS d_hi FROM {name}_b),
{name}_d AS (SELECT *, {_ratio(pos("pixels"), "pixels_lo", "pixels_hi", "pixels_n")} AS s_resolution, {_ratio(pos("size"), "size_lo", "size_hi", "size_n")} AS s_size,
    CASE WHEN known = 0 THEN 5.0 WHEN known = 1 THEN CASE WHEN ts IS NOT NULL THEN 10.0 ELSE 3.0 END WHEN noise OR d_lo = d_hi THEN 5.0
        ELSE coalesce(10.0 * (d_hi - used) / nullif(d_hi - d_lo, 0), 3.0) END AS s_date,
    CASE WHEN i_lo = i_hi THEN 5.0 ELSE least(10.0, greatest(0.0, importance * 10.0 / CAST(9.0 AS DOUBLE))) END AS s_filename,
    CASE WHEN pixels_n >= 2 AND pixels_hi / pixels_lo > 2 THEN least(3.0, 1 + 0.5 * log2(pixels_hi / pixels_lo)) ELSE 1.0 END AS boost,
    coalesce(known >= 2 AND NOT (noise OR d_lo = d_hi) AND d_hi - d_lo >= {priorities.gate_gap_seconds}, false) AS date_decides FROM {name}_c),
{name}_e AS (SELECT *, s_resolution * {float(w["resolution"])} * boost AS w_resolution, s_size * {float(w["size"])} AS w_size,
    s_date * {float(w["date"])} AS w_date, s_filename * {float(w["filename"])} AS w_filename FROM {name}_d),
{name}_f AS (SELECT *, CAST(w_resolution + w_size + w_date + w_filename AS DOUBLE) AS total,
    CASE WHEN provenance = 0 THEN 0 WHEN date_decides THEN 3 ELSE least(provenance, 3) END AS tier FROM {name}_e),
{name} AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tier DESC, round(total, 9) DESC, lower(name), path) AS rank FROM {name}_f)"""


def oracle_sql() -> dict[str, str]:
    shared = """
keyed AS (SELECT *, sha256(text) AS sha256 FROM files), dup AS (SELECT ext, sha256, count(*) AS n, min(path) AS first
    FROM keyed GROUP BY ext, sha256 HAVING count(*) > 1)"""
    pattern = " OR ".join(f"regexp_matches(lower(name), '{p}')" for p in ("\\.tmp$", "\\.temp$", "_backup", "\\.bak$"))
    reason = f"CASE WHEN {pattern} THEN 'excluded_pattern' WHEN size < 1024 THEN 'too_small' END"
    pairs = f"""
reps AS (SELECT p, min(path) AS rep FROM hashes GROUP BY p),
pairs AS (SELECT a.rep AS a, b.rep AS b, hamming(a.p, b.p) AS distance FROM reps a JOIN reps b ON a.rep < b.rep AND hamming(a.p, b.p) <= {THRESHOLD})"""
    rec = HASHES_SQL.replace("WITH raw", "WITH RECURSIVE raw") + "," + pairs + """,
sym AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT u AS node, u AS seen FROM sym UNION SELECT reach.node, sym.v FROM reach JOIN sym ON sym.u = reach.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
placed AS (SELECT h.path, h.p, coalesce(c.component, r.rep) AS component FROM hashes h JOIN reps r ON h.p = r.p LEFT JOIN comp c ON c.node = r.rep),
grouped AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM placed)"""
    # the same with the second hash in every step
    pairs_both = f"""
reps AS (SELECT p, q, min(path) AS rep FROM hashes GROUP BY p, q),
pairs AS (SELECT a.rep AS a, b.rep AS b, hamming(a.p, b.p) AS distance, hamming(a.q, b.q) AS distance2
    FROM reps a JOIN reps b ON a.rep < b.rep AND hamming(a.p, b.p) <= {THRESHOLD_BOTH} AND hamming(a.q, b.q) <= {THRESHOLD_BOTH})"""
    rec_both = rec.replace(pairs, pairs_both).replace("ON h.p = r.p LEFT", "ON h.p = r.p AND h.q = r.q LEFT")
    rivals_sql, scored = _rivals_sql(), _scored_sql()
    small = "SELECT p_partkey, p_size * 15 AS w, p_partkey % 900 AS h FROM part"
    why = "CASE WHEN w < 300 AND h < 300 THEN 'both' WHEN w < 300 THEN 'width' WHEN h < 300 THEN 'height' END"
    replay = rivals_sql + "," + _scored_sql() + "," + _scored_sql(Priorities(order=(1, 2, 4, 3)), "again") + """,
diff AS (SELECT a.grp, a.path AS kept_before, b.path AS kept_after, a.path <> b.path AS changed FROM scored a JOIN again b ON a.grp = b.grp AND a.rank = 1 AND b.rank = 1)"""
    gains = {c: f"CASE WHEN act_{c} THEN k_{c} - r_{c} END" for c in ("resolution", "size", "date", "filename")}
    act = ", ".join(f"max(s_{c}) - min(s_{c}) > 1e-6 AS act_{c}, max(w_{c}) FILTER (rank = 1) AS k_{c}, max(w_{c}) FILTER (rank = 2) AS r_{c}" for c in gains)
    explained = rivals_sql + "," + scored + f""",
two AS (SELECT grp, max(path) FILTER (rank = 1) AS kept, max(path) FILTER (rank = 2) AS rival, max(tier) FILTER (rank = 1) AS kt, max(tier) FILTER (rank = 2) AS rt,
    max(total) FILTER (rank = 1) - max(total) FILTER (rank = 2) AS margin, max(pixels) FILTER (rank = 1) AS kp, max(pixels) FILTER (rank = 2) AS rp,
    max(size) FILTER (rank = 1) AS ks, max(size) FILTER (rank = 2) AS rs, max(importance) FILTER (rank = 1) AS ki, max(importance) FILTER (rank = 2) AS ri,
    max(provenance) FILTER (rank = 1) AS kc, max(provenance) FILTER (rank = 2) AS rc,
    abs(epoch_us(max(ts) FILTER (rank = 1)) - epoch_us(max(ts) FILTER (rank = 2))) / 3600000000.0 AS apart,
    coalesce(max(ts) FILTER (rank = 1) <> max(ts) FILTER (rank = 2), false) AS differ, coalesce(bool_or(ts_source = 'filename' AND ts = date_trunc('day', ts)) FILTER (rank <= 2), false) AS by_day, max(CASE WHEN pixels > 0 THEN pixels END) AS bp, {act} FROM scored GROUP BY grp HAVING count(*) > 1),
gain AS (SELECT *, {", ".join(f"{g} AS g_{c}" for c, g in gains.items())} FROM two),
top AS (SELECT *, greatest(g_resolution, g_size, g_date, g_filename, 0) AS best, -least(g_resolution, g_size, g_date, g_filename, 0) AS lost FROM gain),
crit AS (SELECT *, CASE {" ".join(f"WHEN g_{c} > 1e-9 AND g_{c} >= best - 1e-9 THEN '{c}'" for c in gains)} END AS c0, kt > rt AND margin <= 0.05 AS gate,
    CASE WHEN lost > 0.5 THEN CASE {" ".join(f"WHEN -g_{c} >= lost - 1e-9 THEN '{c}'" for c in gains)} END END AS higher,
    {", ".join(f"CASE WHEN NOT act_{c} AND r{x} > k{x} THEN r{x} / CAST(greatest(k{x}, 1) AS DOUBLE) END AS q_{c}" for c, x in (("size", "s"), ("resolution", "p"), ("filename", "i")))} FROM top),
told AS (SELECT *, CASE WHEN gate THEN 'provenance_gate' WHEN margin > 0.05 AND c0 IS NOT NULL THEN 'criterion_decided' ELSE 'tie' END AS reason,
    greatest(q_size, q_resolution, q_filename) AS q FROM crit),
noted AS (SELECT *, CASE WHEN q_size = q THEN 'size' WHEN q_resolution = q THEN 'resolution' WHEN q_filename = q THEN 'filename' END AS near FROM told),
explained AS (SELECT grp, kept, rival, reason, CASE WHEN reason = 'criterion_decided' THEN c0 END AS criterion, round(margin, 5) AS margin,
    concat_ws('|', CASE WHEN higher IS NOT NULL THEN 'deleted_higher' WHEN near IS NOT NULL THEN 'within_threshold' END,
        CASE WHEN differ AND by_day AND NOT act_date THEN 'day_level' END, CASE WHEN kt > rt THEN 'name_class' END, CASE WHEN gate AND best > 1e-9 THEN 'also_favoured' END,
        CASE WHEN gate AND differ THEN 'date_gap' END, CASE WHEN kp < bp THEN 'resolution_sacrifice' END) AS notes, coalesce(higher, near) AS caveat FROM noted),
details AS (SELECT grp, kc AS kept_class, rc AS rival_class,
    concat_ws('|', {", ".join(f"CASE WHEN gate AND g_{c} > 1e-9 THEN '{c}' END" for c in ("date", "resolution", "size", "filename"))}) AS favoured,
    CASE WHEN gate AND differ THEN round(CAST(apart AS DOUBLE), 5) END AS gap_hours FROM noted)"""
    kg = {c: f"(k.w_{c} - s.w_{c})" for c in gains}
    kbest = f"greatest({', '.join(kg.values())}, 0)"
    deletion = rivals_sql + "," + scored + f"""
SELECT s.grp, s.path, k.path AS kept, CASE WHEN k.tier > s.tier AND k.total - s.total <= 0.05 THEN CASE WHEN s.tier = 0 THEN 'recovered_name' ELSE 'provenance_gate' END
    WHEN k.total - s.total <= 0.05 THEN 'tie_alphabetical' {" ".join(f"WHEN {g} > 1e-9 AND {g} >= {kbest} - 1e-9 THEN 'lower_{c}'" for c, g in kg.items())} ELSE 'tie_alphabetical' END AS reason
FROM scored s JOIN scored k ON s.grp = k.grp AND k.rank = 1 AND s.rank > 1"""
    vid_ratio = _ratio("CAST(vi AS DOUBLE)", "v_lo", "v_hi", "v_n")
    video = rivals_sql + "," + scored + f""",
vid_a AS (SELECT *, CASE video_provenance WHEN 4 THEN 9 WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS vi FROM scored),
vid_b AS (SELECT *, CAST(min(vi) OVER g AS DOUBLE) AS v_lo, CAST(max(vi) OVER g AS DOUBLE) AS v_hi, count(*) OVER g AS v_n FROM vid_a WINDOW g AS (PARTITION BY grp)),
vid_c AS (SELECT *, 3.0 * s_date + 2.0 * s_size + {vid_ratio} AS vt, {vid_ratio} AS s_class, CASE WHEN video_provenance = 0 THEN 0 WHEN date_decides THEN 3 ELSE video_provenance END AS v_tier FROM vid_b),
videos AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v_tier DESC, round(CAST(vt AS DOUBLE), 9) DESC, mtime, path) AS vr FROM vid_c)"""
    video_why = video + """
SELECT s.grp, s.path, CASE WHEN s.vr = 1 THEN o.path ELSE k.path END AS against,
    CASE WHEN k.video_provenance <> o.video_provenance THEN 'provenance' WHEN 3.0 * (k.s_date - o.s_date) > 0.05 THEN 'date' WHEN 2.0 * (k.s_size - o.s_size) > 0.05 THEN 'size'
        WHEN k.s_class - o.s_class > 0.05 THEN 'filename' ELSE 'tie' END AS decided_by,
    CASE WHEN s.vr = 1 AND k.video_provenance = o.video_provenance THEN CASE WHEN k.ts < o.ts THEN 'older' WHEN k.ts > o.ts THEN 'newer' END END AS date_note
FROM videos s JOIN videos k ON k.grp = s.grp AND k.vr = 1 JOIN videos o ON o.grp = s.grp AND o.vr = greatest(s.vr, 2)"""
    causes = rivals_sql + "," + scored + """,
dayed AS (SELECT * REPLACE (CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, 'none' AS ts_source) FROM rivals),""" + _scored_sql(name="older", source="dayed") + """,
both_runs AS (SELECT s.grp, min(s.path) AS kept_before, max(s.path) FILTER (s.rank = 1) AS kept_after, max(s.tier) FILTER (s.rank = 1) > arg_min(s.tier, s.path) AS gate,
    min(round(o.s_date, 6)) = max(round(o.s_date, 6)) AND min(round(s.s_date, 6)) <> max(round(s.s_date, 6)) AS dated FROM scored s JOIN older o ON s.grp = o.grp AND s.path = o.path GROUP BY s.grp),
causes AS (SELECT grp, kept_before, kept_after, CASE WHEN kept_before = kept_after THEN NULL WHEN gate THEN 'name_gate' WHEN dated THEN 'date_restored' ELSE 'rescored' END AS cause FROM both_runs)"""
    restored = FILES_SQL + """,
items AS (SELECT path AS original, '/bin/' || name || CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END AS reported, size FROM files),
raw_bin AS (SELECT '/bin/' || CASE WHEN doc_id % 4 = 0 THEN 'x/' ELSE '' END || (doc_id % 50) || '/' || name AS spot, name, size FROM files WHERE doc_id % 5 <> 0),
bins AS (SELECT CASE WHEN spot LIKE '/bin/1_/%' THEN '/bin/' || name ELSE spot END AS actual, name, max(size) AS bin_size FROM raw_bin GROUP BY 1, 2),
keyed AS (SELECT *, name AS k FROM bins UNION SELECT *, """ + _plain_sql("name") + """ FROM bins),
hits AS (SELECT original, actual, size = bin_size AS same, 1 AS step FROM items JOIN bins ON reported = actual
    UNION ALL SELECT original, actual, size = bin_size, 2 FROM items JOIN keyed ON string_split(reported, '/')[-1] = k
    UNION ALL SELECT original, actual, size = bin_size, 3 FROM items JOIN keyed ON string_split(original, '/')[-1] = k),
nearest AS (SELECT * FROM hits QUALIFY step = min(step) OVER (PARTITION BY original)),
sized AS (SELECT * FROM nearest QUALIFY same = max(same) OVER (PARTITION BY original)),
placed AS (SELECT original, min(actual) AS actual, count(*) AS n FROM sized GROUP BY original),
restored AS (SELECT i.original, p.actual, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'found' ELSE 'missing' END AS status FROM items i LEFT JOIN placed p ON i.original = p.original)"""
    survivors = _evidence_sql() + """,
keyed AS (SELECT *, sha256(text) AS sha256, count(*) OVER (PARTITION BY ext, sha256(text)) AS copies FROM dat),
rivals AS (SELECT ext || '-' || sha256 AS grp, path, name, pixels, size, mtime, importance, provenance, coalesce(name_ts, mtime) AS ts,
    CASE WHEN name_ts IS NOT NULL THEN 'filename' ELSE 'modified' END AS ts_source FROM keyed WHERE copies > 1),""" + scored + """
SELECT grp, path, tier, round(total, 6) AS total, rank = 1 AS is_kept FROM scored"""
    return {
        "exact_dup_groups": FILES_SQL + "," + shared + " SELECT * FROM dup",
        "exact_dup_members": FILES_SQL + "," + shared + " SELECT ext, sha256, path FROM keyed SEMI JOIN dup USING (ext, sha256)",
        "exact_dup_images_style": FILES_SQL + " SELECT sha256(text) AS sha256, count(*) AS n, min(path) AS first FROM files GROUP BY 1 HAVING count(*) > 1",
        "exact_dup_images_members": FILES_SQL + " SELECT sha256(text) AS sha256, path FROM files QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1",
        "exact_dup_totals": FILES_SQL + "," + shared + " SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS deletable FROM dup",
        "exact_dup_survivors": survivors,
        "size_candidates": FILES_SQL + " SELECT path, ext, size FROM (SELECT *, count(*) OVER (PARTITION BY ext, size) AS n FROM files) WHERE n > 1",
        "sample_stats": FILES_SQL + f""",
a AS (SELECT *, encode(text) AS b, count(*) OVER (PARTITION BY ext, size) AS n FROM files), c AS (SELECT * FROM a WHERE n > 1),
e AS (SELECT *, count(*) OVER (PARTITION BY ext, size, hex(b)[1:{2 * SAMPLE}], CASE WHEN size > {2 * SAMPLE} THEN hex(b)[-{2 * SAMPLE}:] ELSE '' END) AS m FROM c)
SELECT (SELECT count(*) FROM files) AS scanned, count(*) AS size_candidates, CAST(coalesce(sum(size), 0) AS BIGINT) AS naive_bytes, CAST(coalesce(sum(least(size, {2 * SAMPLE})), 0) AS BIGINT) AS sampled_bytes,
    count(*) FILTER (m > 1) AS sample_candidates, CAST(coalesce(sum(size) FILTER (m > 1), 0) AS BIGINT) AS full_bytes FROM e""",
        "skip_reasons": FILES_SQL + f" SELECT path, {reason} AS skip_reason FROM files",
        "skip_summary": FILES_SQL + f" SELECT reason, count(*) AS n, reason = 'excluded_pattern' AS liftable FROM (SELECT {reason} AS reason FROM files) WHERE reason IS NOT NULL GROUP BY reason",
        "kept_files": FILES_SQL + f" SELECT path, size FROM files WHERE ext IN ('.en', '.de') AND ({reason}) IS NULL",
        "name_importance": _evidence_sql() + " SELECT path, importance FROM dat",
        "name_provenance": rivals_sql + " SELECT path, provenance, video_provenance FROM rivals",
        "filename_dates": _evidence_sql() + " SELECT path, strftime(name_ts, '%Y-%m-%d %H:%M:%S') AS ts FROM dat",
        "name_parts": FILES_SQL + f" SELECT path, {_STEM_SQL} AS stem, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix, name AS base, {_plain_sql('name')} AS plain FROM files",
        "name_marks": FILES_SQL + ", x AS (SELECT *, size * size * 7 AS z FROM files) SELECT path, regexp_matches(lower(name), 'recovered|copy|duplicate|backup|temp|tmp') AS recovery, "
        + ", ".join("CASE WHEN z < 1024 THEN z || ' B' " + " ".join(f"WHEN {limit} THEN printf('%.{places}f {u}', z / {1024.0 ** k})" for k, (u, limit) in enumerate(zip(units, ("z < 1048576", "z < 1073741824", "z < 1099511627776", "true")), 1)) + f" END AS {name}" for name, places, units in (("bytes", 1, ("KiB", "MiB", "GiB", "TiB")), ("short", 2, ("KB", "MB", "GB", "TB")))) + " FROM x",
        "file_info": _evidence_sql() + """,
x AS (SELECT *, doc_id % 4 <> 0 AS pic, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN TIMESTAMP '2011-02-03 04:05:06' END AS exif FROM dat),
y AS (SELECT *, CASE WHEN name_ts IS NOT NULL AND (exif IS NULL OR name_ts <= exif) THEN 'filename' WHEN exif IS NOT NULL THEN 'exif' WHEN NOT pic THEN 'modified' ELSE 'none' END AS src FROM x),
z AS (SELECT *, CASE src WHEN 'filename' THEN name_ts WHEN 'exif' THEN exif WHEN 'modified' THEN mtime END AS best FROM y)
SELECT path, name, size AS size_bytes, round_even(size / CAST(1048576 AS DOUBLE), 2) AS size_mb, CASE WHEN pic THEN CAST(pixels / 1000 AS INTEGER) ELSE 0 END AS width, CASE WHEN pic THEN 1000 ELSE 0 END AS height,
    CASE WHEN pic THEN pixels ELSE 0 END AS resolution, CASE WHEN pic THEN 'PNG' ELSE 'Unknown' END AS format, CASE WHEN pic THEN 'RGB' ELSE 'Unknown' END AS mode,
    strftime(best, '%Y-%m-%d %H:%M:%S') AS extracted_date, src AS date_source, coalesce(src = 'filename' AND best = date_trunc('day', best), false) AS date_only, importance AS filename_importance,
    strftime(mtime, '%Y-%m-%d %H:%M:%S') AS modified_time, CASE WHEN pic AND pixels > 0 THEN 'image' ELSE 'file' END AS kind FROM z""",
        "best_dates": _evidence_sql() + """,
x AS (SELECT *, CASE WHEN pixels % 3000 = 0 THEN mtime END AS exif FROM dat)
SELECT path, strftime(CASE WHEN name_ts IS NOT NULL AND (exif IS NULL OR name_ts <= exif) THEN name_ts WHEN exif IS NOT NULL THEN exif ELSE mtime END, '%Y-%m-%d %H:%M:%S') AS ts,
    CASE WHEN name_ts IS NOT NULL AND (exif IS NULL OR name_ts <= exif) THEN 'filename' WHEN exif IS NOT NULL THEN 'exif' ELSE 'modified' END AS source FROM x""",
        "score_table": rivals_sql + "," + scored + " SELECT grp, path, " + ", ".join(f"round(CAST({c} AS DOUBLE), 5) AS {c}" for c in ("s_resolution", "s_size", "s_date", "s_filename", "boost", "total")) + ", date_decides FROM scored",
        "best_file": rivals_sql + "," + scored + " SELECT grp, path, tier FROM scored WHERE rank = 1",
        "best_video": video + " SELECT grp, path, v_tier AS tier FROM videos WHERE vr = 1",
        "video_reasons": video_why,
        "selection_reasons": explained + " SELECT * FROM explained",
        "reason_details": explained + " SELECT * FROM details",
        "reason_counts": explained + " SELECT reason, count(*) AS n FROM explained GROUP BY reason",
        "deletion_reasons": deletion,
        "resolution_sacrifice": rivals_sql + "," + scored + " SELECT grp, pixels AS kept_px, best_px FROM (SELECT *, max(CASE WHEN pixels > 0 THEN pixels END) OVER (PARTITION BY grp) AS best_px FROM scored) WHERE rank = 1 AND pixels < best_px",
        "replay_diff": replay + " SELECT * FROM diff",
        "replay_causes": causes + " SELECT * FROM causes",
        "replay_cause_counts": causes + " SELECT cause, count(*) AS n FROM causes GROUP BY cause",
        "restore_plan": restored + " SELECT * FROM restored",
        "restore_indexed": restored + " SELECT * FROM restored",
        "restore_counts": restored + " SELECT status, count(*) AS n FROM restored GROUP BY status",
        "replay_counts": replay + " SELECT changed, count(*) AS n FROM diff GROUP BY changed",
        "hamming_pairs": HASHES_SQL + "," + pairs + " SELECT a, b, CAST(distance AS INTEGER) AS distance FROM pairs",
        "hamming_pairs_both": HASHES_SQL + "," + pairs_both + " SELECT a, b, CAST(distance AS INTEGER) AS distance, CAST(distance2 AS INTEGER) AS distance2 FROM pairs",
        "similar_groups_both": rec_both + " SELECT path, component FROM grouped WHERE n > 1",
        "similar_totals": rec_both + " SELECT CAST(coalesce(sum(m - 1), 0) AS BIGINT) AS similar, count(*) AS groups FROM (SELECT component, count(*) AS m FROM grouped WHERE n > 1 GROUP BY component)",
        "similar_groups": rec + " SELECT path, component FROM grouped WHERE n > 1",
        "similarity_pct": rec + " SELECT g.component AS anchor, g.path AS other, round_even((64 - hamming(g.p, f.p)) / CAST(64 AS DOUBLE) * 100, 1) AS pct FROM grouped g JOIN hashes f ON f.path = g.component WHERE g.n > 1 AND g.path <> g.component",
        "hamming_sides": HASHES_SQL + " SELECT h.path, CAST(hamming(h.p, f.p) AS INTEGER) AS distance, CAST(hamming(h.q, f.q) AS INTEGER) AS distance2, round_even((64 - hamming(h.p, f.p)) / CAST(64 AS DOUBLE) * 100, 1) AS pct FROM hashes h, (SELECT * FROM hashes WHERE path = 'v000000') f",
        "small_filter": f"SELECT p_partkey, {why} AS reason FROM ({small}) WHERE w < 300 OR h < 300",
        "small_stats": f"SELECT count(*) AS n, count(*) FILTER (r = 'both') AS n_both, count(*) FILTER (r = 'width') AS n_width, count(*) FILTER (r = 'height') AS n_height, CAST(coalesce(sum(p_partkey), 0) AS BIGINT) AS bytes FROM (SELECT *, {why} AS r FROM ({small})) WHERE r IS NOT NULL",
        "recycle_destinations": FILES_SQL + """,
f AS (SELECT doc_id, path, string_split(path, '/')[3] AS folder, substr(name, 1, 3) || CASE WHEN doc_id % 11 = 0 THEN '_' || (1 + doc_id % 4) ELSE '' END AS s, CASE WHEN doc_id % 6 = 0 THEN '' ELSE '.dat' END AS e FROM files),
old AS (SELECT DISTINCT folder, substr(s || e, 1, 3) || '_' || (doc_id % 5) || '.dat' AS whole FROM f WHERE doc_id % 19 = 0),
every AS (SELECT folder, list(DISTINCT whole) AS all_names FROM (SELECT folder, s || e AS whole FROM f UNION SELECT folder, whole FROM old) GROUP BY folder),
k AS (SELECT f.*, all_names, row_number() OVER (PARTITION BY folder, s, e ORDER BY path) - CASE WHEN old.whole IS NULL THEN 1 ELSE 0 END AS k
    FROM f JOIN every USING (folder) LEFT JOIN old ON old.folder = f.folder AND old.whole = s || e)
SELECT path, '/bin/duplicates/' || folder || '/' || s || CASE WHEN k > 0 THEN '_' || list_filter(range(1, k + 1 + len(all_names)), lambda n: NOT list_contains(all_names, s || '_' || n || e))[k] ELSE '' END || e AS destination FROM k""",
        "folder_union": FILES_SQL + " SELECT path, size FROM files WHERE ext IN ('.en', '.de', '.fr')",
        "unhashed": FILES_SQL + " SELECT path, size FROM files WHERE size % 7 = 0",
        "cross_volume": FILES_SQL + f" SELECT CAST(coalesce(sum(size) FILTER (doc_id % 3 <> 0), 0) AS BIGINT) AS needed, coalesce(sum(size) FILTER (doc_id % 3 <> 0), 0) = 0 OR coalesce(sum(size) FILTER (doc_id % 3 <> 0), 0) + {512 << 20} <= {1 << 30} AS fits FROM files",
        "content_digests": FILES_SQL + " SELECT path, sha256(text) AS sha256 FROM files",
    } | storage.oracle_sql()
