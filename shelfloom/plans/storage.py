"""Queries that go through real files, ledgers and indexes: documents are written
out as files of a library on the shared folder, and scanned, hashed, moved and
looked up there. What comes back is held against SQL over documents."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom import journal, ledger, report
from shelfloom.bin_index import BinIndex
from shelfloom.config import Filters
from shelfloom.functions import images
from shelfloom.functions.hashing import threshold_of
from shelfloom.operators import filters
from shelfloom.plans.library import FILES_SQL, files, names
from shelfloom.runtime import shared_dir, ship, table
from shelfloom.sources import files as source
from shelfloom.sources import library

WANTED = [".jpg", ".jpeg", ".png", ".mp4", ".mov", ".tmp"]
#: What becomes of a document: a broken link, a folder with a file's name, a file of more bytes than the filter allows, or its text.
KIND = "CASE WHEN doc_id % 29 = 3 THEN 'broken' WHEN doc_id % 31 = 5 THEN 'folder' WHEN doc_id % 37 = 7 THEN 'large' ELSE 'text' END"
#: Its place: some folders and some names are hidden.
PLACE = (
    "source || CASE WHEN doc_id % 23 = 1 THEN '/.cache/' ELSE '/' END || CAST(doc_id AS STRING) || '/' || CASE WHEN doc_id % 17 = 2 THEN '.' ELSE '' END || name"
)
LARGE = 3 << 20
SCAN = Filters(max_size_mb=2)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage, as the executors' file system has it."""
    root = shared_dir(spark)
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if "://" in root:
        raise ValueError(f"files are written to mounted storage, and {root} is none")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def exported(spark: SparkSession, sf_dir: str) -> str:
    """The root of a library that holds every document as a file. Writing one again changes nothing."""
    ship(spark)
    root = _folder(spark, "library")
    os.makedirs(root)
    docs = names(table(spark, sf_dir, "documents")).select(F.expr(PLACE).alias("place"), F.expr(KIND).alias("kind"), F.col("text").cast("binary").alias("content"), "doc_id")

    def write(frames):
        for frame in frames:
            for place, kind, content, doc_id in zip(frame["place"], frame["kind"], frame["content"], frame["doc_id"], strict=True):
                path = f"{root}/{place}"
                os.makedirs(path if kind == "folder" else os.path.dirname(path), exist_ok=True)
                beside = f"{path}.{uuid.uuid4().hex}"
                if kind == "broken":
                    os.symlink(f"{root}/nowhere", beside)
                elif kind != "folder":
                    with open(beside, "wb") as f:
                        f.write(b"" if kind == "large" else content)
                        if kind == "large":
                            f.truncate(LARGE + int(doc_id))
                if kind != "folder":
                    os.replace(beside, path)
            yield frame[["doc_id"]]

    docs.mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return root


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    found = library.read(spark, [root], numPartitions="8").filter(F.col("ext").isin(WANTED))
    return filters.scanned(found, WANTED, Filters(max_size_mb=SCAN.max_size_mb, own_output=(f"{root}/src3",)))


def _below(root: str, column: str = "path") -> F.Column:
    return F.substring(column, len(root) + 2, 1 << 30)


def scan_library(s, d):
    """Every skip test on real files: broken links, folders named like files, own output, hidden, patterns, sizes."""
    root = exported(s, d)
    # what is no file has no size
    size = F.when(F.col("skip_reason").isin("unreadable", "not_regular"), F.lit(-1)).otherwise(F.col("size"))
    return _scanned(s, root).select(_below(root).alias("place"), size.cast("long").alias("size"), "skip_reason")


def skips_observed(s, d):
    """The summary of a scan, counted by the scan itself."""
    found, seen = filters.counted(_scanned(s, exported(s, d)))
    filters.kept(found).write.format("noop").mode("overwrite").save()
    return filters.observed_summary(s, seen)


def file_digests(s, d):
    """Whole and sampled digests of the kept files, read in partitions of equal bytes."""
    root = exported(s, d)
    kept = filters.kept(_scanned(s, root)).select("path", "size")
    whole, sample = source.streamed_hashes(kept), source.streamed_hashes(kept, 64).withColumnRenamed("sha256", "sample")
    return kept.join(whole, "path").join(sample, "path").select(_below(root).alias("place"), "size", "sha256", "sample")


def journalled_moves(s, d):
    """Moves in tasks by the journal: files whose survivor goes too stay, and names that meet in the bin get numbers."""
    root = exported(s, d)
    kept = filters.kept(_scanned(s, root)).select("path", "size", F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("long").alias("doc_id"))
    plan = kept.filter("doc_id % 3 = 0").select(
        F.col("path").alias("original"), F.concat(F.lit(f"{root}-bin/"), F.col("doc_id").cast("string"), F.lit(".dat")).alias("destination"), "size",
        F.when(F.expr("doc_id % 2 = 0"), F.lit(f"{root}/nowhere.jpg")).alias("survivor"),
    )
    place = journal.begin(plan, f"{root}-journal", "run")
    done = journal.resume(s, place)
    return done.select(_below(root, "original").alias("place"), _below(f"{root}-bin", "destination").alias("destination"), "outcome", "size")


def _history(s, d) -> str:
    """A ledger with three runs: two real ones of two sections and a dry one."""
    root = f"{_folder(s, 'ledger')}"
    f = files(s, d).select("doc_id", "path", "size", F.expr("substring(ext, 2) || '-' || CAST(doc_id % 97 AS STRING)").alias("grp"))
    outcome = "CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'skipped_readonly' ELSE 'moved' END"
    for section, run, k, dry in (("images", "r1", 0, False), ("video", "r2", 1, False), ("images", "r3", 2, True)):
        rows = f.filter(F.expr(f"doc_id % 3 = {k}")).select(
            "grp", F.col("path").alias("original"), F.expr("'/bin/' || CAST(doc_id AS STRING)").alias("destination"),
            F.lit("dry_run").alias("outcome") if dry else F.expr(outcome).alias("outcome"), F.lit(False).alias("is_kept"), F.lit("tie").alias("reason"), "size",
        )
        when = datetime(2024, 1, k + 1)
        ledger.append(rows, root, section=section, run=run, operation="duplicates", dry_run=dry, bin_path="/bin", started=when, finished=when)
    return root


def run_history(s, d):
    """What every run did, from the table of runs."""
    return ledger.runs(s, _history(s, d)).select("section", "run", "operation", "dry_run", "files", "moved", "failed", "skipped", "moved_bytes")


def undo_history(s, d):
    """What can be undone in one section: its real runs' folders alone are read."""
    return ledger.undo_items(s, _history(s, d), "images").select("original", "reported", "size", "run")


def restore_indexed(s, d):
    """``restore_plan`` on an index of the bin that two runs have added to."""
    from shelfloom.plans import queries as Q

    removed, in_bin = Q.removed_and_bin(s, d)
    index = BinIndex(s, _folder(s, "bin-index"), f"bin_{uuid.uuid4().hex}", buckets=8)
    index.add(in_bin.filter("size % 2 = 0"))
    index.add(in_bin.filter("size % 2 = 1 or size % 3 = 0"))
    return index.located(removed).select("original", "actual", "status")


#: Groups of four documents by number; the first stays, and what the report says of each file is made from its columns.
_LEDGER = {
    "grp": "lpad(CAST(doc_id DIV 4 AS STRING), 8, '0')",
    "is_kept": "doc_id % 4 = 0",
    "reason": "CASE doc_id % 3 WHEN 0 THEN 'criterion_decided' WHEN 1 THEN 'tie' ELSE 'lower_size' END",
    "criterion": "CASE WHEN doc_id % 2 = 0 THEN 'date' ELSE 'size' END",
    "moved": "CASE WHEN doc_id % 4 > 0 AND doc_id % 5 > 0 THEN '/bin/' || CAST(doc_id AS STRING) || '/' || name END",
    "percent": "CASE WHEN doc_id % 4 > 1 THEN '9' || CAST(doc_id % 4 AS STRING) || '.5' END",
    "width": "CASE WHEN doc_id % 6 > 0 THEN n_chars END",
    "height": "CAST(1000 AS INT)",
    "size_mb": "CAST(doc_id % 50 AS STRING) || '.25'",
    "extracted_date": "CASE WHEN doc_id % 3 = 0 THEN '2020-01-02 03:04:05' END",
    "date_source": "CASE WHEN doc_id % 3 = 0 THEN 'filename' END",
    "date_only": "doc_id % 9 = 0",
    "filename_importance": "CAST(doc_id % 9 + 1 AS INT)",
    "modified_time": "'2021-05-06 07:08:09'",
}


def _reports(s, d) -> list[str]:
    """Reports that tasks have rendered and written, of a few hundred groups each."""
    docs = names(table(s, d, "documents"))
    rows = docs.select(F.expr("'/lib/' || source || '/' || CAST(doc_id AS STRING) || '/' || name").alias("path"), *[F.expr(x).alias(c) for c, x in _LEDGER.items()])
    lines = report.rendered(rows, "similar")
    lines = lines.withColumn("report", F.floor((F.col("at._number") - 1) / 200))
    folder = _folder(s, "reports")
    done = report.write_rendered(lines, "similar", folder, "similar_images_deletion", dry_run=False, bin_path="/bin")
    return [folder] if not done.isEmpty() else []


def report_items(s, d):
    """What reports say was moved, read back from their lines."""
    return report.parse(s, _reports(s, d)).select("original", "reported")


def report_groups(s, d):
    """The groups of reports, read back from their lines."""
    found = report.parse_groups(s, _reports(s, d)).withColumn("dimensions", F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
    return found.drop("report", "grp", "width", "height")


#: 72 bytes of digests a document, the grey pixels of a picture of 9 by 8.
_PIXELS = "sha2(concat(text, '1'), 256) || sha2(concat(text, '2'), 256) || sha2(concat(text, '3'), 256)"
_PICTURE = "CASE WHEN doc_id % 7 = 3 THEN 'cut' WHEN doc_id % 11 = 5 THEN 'heic' WHEN doc_id % 13 = 6 THEN 'noise' WHEN doc_id % 17 = 4 THEN 'short' ELSE 'whole' END"


def picture_info(s, d):
    """Header, verdict and hash of a picture that is made of each document: whole, cut off, of another format, noise, too short."""
    docs = table(s, d, "documents").select("doc_id", F.expr(_PICTURE).alias("kind"), F.expr(_PIXELS).alias("h"))
    head = b"BM" + struct.pack("<IHHI", 54 + 8 * 28, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 9, 8, 1, 24, 0, 8 * 28, 0, 0, 0, 0)
    # rows from the last to the first, three equal bytes a pixel, rows of whole words
    lines = [F.concat(*[F.repeat(F.substring("h", 2 * (9 * r + c) + 1, 2), 3) for c in range(9)], F.lit("00")) for r in reversed(range(8))]
    whole = F.unhex(F.concat(F.lit(head.hex()), *lines))
    content = F.when(F.col("kind") == "cut", F.substring(whole, 1, 100)).when(F.col("kind") == "short", F.substring(whole, 1, 40))
    content = content.when(F.col("kind") == "whole", whole).otherwise(F.unhex("h"))
    ext = F.when(F.col("kind") == "heic", ".heic").when(F.col("kind") == "noise", ".jpg").otherwise(".bmp")
    media = images.media(docs.select(F.col("doc_id").cast("string").alias("path"), ext.alias("ext"), content.alias("content")))
    bits = F.array_join(F.transform("dhash", lambda w: F.lpad(F.bin(w), 64, "0")), "")
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return media.select("path", F.when(F.col("width").isNotNull(), size).alias("dimensions"), "format", "verdict", bits.alias("dhash"))


def thresholds(s, d):
    """The Hamming threshold of a base and a hash side, for every part."""
    p = table(s, d, "part").select("p_partkey", F.expr("CAST(p_size % 10 AS INT)").alias("base"), F.element_at(F.array(*map(F.lit, (8, 10, 12, 16))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("side"))
    return p.withColumn("threshold", threshold_of(F.col("base"), F.col("side")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (scan_library, skips_observed, file_digests, journalled_moves, run_history, undo_history, restore_indexed, report_items, report_groups, picture_info, thresholds)}


_LIB = FILES_SQL.rstrip()
_TOLD = (
    _LIB
    + ", led AS (SELECT f.path, f.name, f.doc_id, "
    + ", ".join(f"{x.replace('AS STRING', 'AS VARCHAR').replace(' DIV ', ' // ')} AS {c}" for c, x in _LEDGER.items())
    + " FROM (SELECT f.*, d.n_chars FROM files f JOIN documents d USING (doc_id)) f)"
)
_SEEN = (
    _LIB
    + f"""
, named AS (SELECT f.doc_id, f.name, f.text, d.source FROM files f JOIN documents d USING (doc_id)),
lib AS (SELECT doc_id, text, {PLACE.replace("AS STRING", "AS VARCHAR")} AS place, {KIND} AS kind, source, name FROM named),
sized AS (SELECT *, CASE kind WHEN 'large' THEN {LARGE} + doc_id WHEN 'text' THEN strlen(text) END AS size,
    regexp_extract(regexp_extract(lower(place), '[^/]*$'), '^.+([.][^.]+)$', 1) AS ext,
    regexp_extract(lower(place), '[^/]*$') AS low FROM lib),
seen AS (SELECT *, CASE
    WHEN kind = 'broken' THEN 'unreadable' WHEN kind = 'folder' THEN 'not_regular' WHEN source = 'src3' THEN 'own_output'
    WHEN doc_id % 23 = 1 OR doc_id % 17 = 2 THEN 'hidden'
    WHEN low LIKE '%.tmp' OR low LIKE '%.temp' OR low LIKE '%.bak' OR contains(low, '_backup') THEN 'excluded_pattern'
    WHEN size < 1024 THEN 'too_small' WHEN size > {SCAN.max_size_mb} * 1024 * 1024 THEN 'too_large' END AS skip_reason
  FROM sized WHERE ext IN ({", ".join(f"'{e}'" for e in WANTED)}))
"""
)


def oracle_sql() -> dict[str, str]:
    bytes_of = "lpad(printf('%x', size), 16, '0')"
    return {
        "scan_library": _SEEN + "SELECT place, CAST(CASE WHEN kind IN ('large', 'text') THEN size ELSE -1 END AS BIGINT) AS size, skip_reason FROM seen",
        "skips_observed": _SEEN
        + "SELECT skip_reason AS reason, count(*) AS n, skip_reason IN ('too_large', 'excluded_pattern', 'hidden') AS liftable FROM seen WHERE skip_reason IS NOT NULL GROUP BY skip_reason",
        "file_digests": _SEEN
        + f"""SELECT place, CAST(size AS BIGINT) AS size, sha256(text) AS sha256,
          sha256(unhex({bytes_of}) || CASE WHEN size > 128 THEN encode(text)[1:64] || encode(text)[size - 63:] ELSE encode(text)[1:64] END) AS sample
        FROM seen WHERE skip_reason IS NULL""",
        "journalled_moves": _SEEN
        + """SELECT place, CASE WHEN doc_id % 2 = 1 THEN doc_id || '.dat' END AS destination,
          CASE WHEN doc_id % 2 = 0 THEN 'skipped_error' ELSE 'moved' END AS outcome, CAST(size AS BIGINT) AS size
        FROM seen WHERE skip_reason IS NULL AND doc_id % 3 = 0""",
        "run_history": _LIB
        + """, r AS (SELECT CASE doc_id % 3 WHEN 1 THEN 'video' ELSE 'images' END AS section, 'r' || (1 + doc_id % 3) AS run, doc_id % 3 = 2 AS dry_run, size,
            CASE WHEN doc_id % 3 = 2 THEN 'dry_run' WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'skipped' ELSE 'moved' END AS outcome FROM files)
        SELECT section, run, 'duplicates' AS operation, dry_run, count(*) AS files, count(*) FILTER (outcome = 'moved') AS moved, count(*) FILTER (outcome = 'failed') AS failed,
          count(*) FILTER (outcome = 'skipped') AS skipped, CAST(coalesce(sum(size) FILTER (outcome = 'moved'), 0) AS BIGINT) AS moved_bytes FROM r GROUP BY ALL""",
        "report_items": _TOLD + " SELECT path AS original, moved AS reported FROM led WHERE moved IS NOT NULL",
        "report_groups": _TOLD
        + """, chosen AS (SELECT grp, CASE reason WHEN 'criterion_decided' THEN 'Decided by ' || criterion WHEN 'tie' THEN 'All criteria about equal; the first by name stays'
            ELSE 'Less size' END AS reason FROM led WHERE is_kept)
        SELECT l.is_kept, c.reason, l.path, l.name, l.extracted_date || CASE WHEN l.date_only THEN ' (day only)' ELSE '' END AS extracted_date, l.date_source, l.filename_importance,
          CASE WHEN l.width > 0 THEN l.width || 'x' || l.height END AS dimensions, CAST(l.size_mb AS DOUBLE) AS size_mb, l.modified_time
        FROM led l LEFT JOIN chosen c USING (grp)""",
        "picture_info": f"""WITH p AS (SELECT doc_id, {_PICTURE} AS kind, sha256(concat(text, '1')) || sha256(concat(text, '2')) || sha256(concat(text, '3')) AS h FROM documents),
          v AS (SELECT *, list_transform(range(0, 72), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)) AS px FROM p)
        SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN kind IN ('whole', 'cut', 'short') THEN '9x8' END AS dimensions, CASE WHEN kind IN ('whole', 'cut', 'short') THEN 'BMP' END AS format,
          CASE kind WHEN 'whole' THEN 'ok' WHEN 'heic' THEN 'unsupported' ELSE 'corrupt' END AS verdict,
          CASE WHEN kind = 'whole' THEN array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN px[9 * (i // 8) + i % 8 + 2] > px[9 * (i // 8) + i % 8 + 1] THEN '1' ELSE '0' END), '') END AS dhash
        FROM v""",
        "thresholds": """SELECT p_partkey, base, side, CAST(CASE WHEN side = 8 THEN greatest(1, b) ELSE greatest(1, round_even(b * side * side / 64.0, 0)) END AS INTEGER) AS threshold FROM (
          SELECT *, CASE WHEN base = 0 THEN 5 ELSE base END AS b FROM (
            SELECT p_partkey, CAST(p_size % 10 AS INTEGER) AS base, CAST(CASE p_partkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 12 ELSE 16 END AS INTEGER) AS side FROM part))""",
        "undo_history": _LIB + "SELECT path AS original, '/bin/' || doc_id AS reported, size, 'r1' AS run FROM files WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0",
    }
