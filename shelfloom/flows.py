"""Whole flows over files: from folders to a decision ledger.

Files are walked, their headers and pixels read where they lie, and only paths,
sizes, digests and hashes are joined and grouped. A ledger holds one row a file
of each group, with ``is_kept``; ``actions`` applies it.

Defined results: files that cannot be read or decoded are in no group; a folder
without files gives an empty ledger.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom import catalog
from shelfloom.config import DEFAULT_FILTERS, Filters, Priorities, scaled_threshold
from shelfloom.functions import dates, images, names
from shelfloom.operators import dedup, filters, selection, similar
from shelfloom.runtime import materialise
from shelfloom.sources import files as source
from shelfloom.sources import library
from shelfloom.sources.balance import balanced


def kept_files(spark: SparkSession, folders: list[str], extensions: list[str], scan: Filters = DEFAULT_FILTERS) -> DataFrame:
    """The files of several folders that pass the filters. Folders that lie in each other are walked as one; others by the
    library source, which asks no file of another extension for its size."""
    roots = list(dict.fromkeys(os.path.abspath(f) for f in folders))
    nested = any(a != b and a.startswith(b.rstrip("/") + "/") for a in roots for b in roots)
    if nested or not roots or not extensions:
        found = source.files(spark, folders, extensions)
    else:
        found = library.read(spark, roots, numPartitions=str(4 * spark.sparkContext.defaultParallelism)).filter(F.col("ext").isin(list(extensions)))
    return filters.kept(filters.scanned(found, extensions, scan))


def media_of(found: DataFrame, side: int = 8, pixels: bool = True) -> DataFrame:
    """Header, tags and, with ``pixels``, verdict and hashes of every file, by its path. The files are read in partitions of
    about equal bytes."""
    dealt = balanced(found, F.col("size"), "path")
    return materialise(images.media(source.with_content(dealt), side, pixels), "media")


def file_info(files: DataFrame, media: DataFrame, *, oldest: bool = True, use_mtime: bool = False) -> DataFrame:
    """What is known of each of ``files`` (path, name, size, mtime): one row a
    path with name, size_bytes, size_mb, width, height, resolution, format,
    mode, extracted_date, date_source, date_only, filename_importance,
    modified_time, kind, provenance, ts. Without a header width and height are 0. Files that
    are no pictures fall back to their modification time; pictures only if
    ``use_mtime``."""
    known = files.join(media.select("path", "width", "height", "format", "mode", "exif"), "path", "left")
    picture = F.coalesce(F.col("width") * F.col("height") > 0, F.lit(False))
    mtime = F.when(F.lit(use_mtime) | ~picture, F.col("mtime"))
    best = dates.best_date(dates.filename_timestamp(F.col("name")), dates.exif_timestamp(F.col("exif")), mtime, oldest)
    known = names.evidence(known.withColumn("_best", best))
    shown = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return known.select(
        "path",
        "name",
        F.col("size").alias("size_bytes"),
        F.bround(F.col("size") / 1048576.0, 2).alias("size_mb"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0)).cast("long").alias("resolution"),
        F.coalesce("format", F.lit("Unknown")).alias("format"),
        F.coalesce("mode", F.lit("Unknown")).alias("mode"),
        shown(F.col("_best.ts")).alias("extracted_date"),
        F.col("_best.source").alias("date_source"),
        F.coalesce(dates.is_day_level(F.col("_best.ts"), F.col("_best.source")), F.lit(False)).alias("date_only"),
        F.col("importance").alias("filename_importance"),
        "provenance",
        shown(F.col("mtime")).alias("modified_time"),
        F.when(picture, "image").otherwise("file").alias("kind"),
        F.col("_best.ts").alias("ts"),
    )


def rivals(groups: DataFrame, info: DataFrame, group: str) -> DataFrame:
    """``groups`` (path, ``group``) with all evidence that selection asks for."""
    return groups.select("path", F.col(group).alias("grp")).join(info, "path").select(
        "grp", "path", "name", F.col("resolution").alias("pixels"), F.col("size_bytes").alias("size"),
        F.col("filename_importance").alias("importance"), "provenance", "ts", F.col("date_source").alias("ts_source"),
    )


def similar_ledger(
    spark: SparkSession, folders: list[str], *, mode: str = "normal", base_threshold: int = 5, scan: Filters = DEFAULT_FILTERS, priorities: Priorities = Priorities()
) -> dict:
    """The similar-image pass: ``ledger`` (grp, path, ..., rank, is_kept),
    ``percent`` (anchor, other, pct), ``info``, ``totals`` (similar, groups),
    ``unhashed`` (see ``similar.unhashed_report``) and ``scanned``. ``mode``
    sets the side of the hashes, the threshold grows with it."""
    from shelfloom.config import HASH_SIDE

    side = HASH_SIDE[mode]
    threshold = scaled_threshold(base_threshold, side)
    found = materialise(kept_files(spark, folders, list(catalog.IMAGE), scan), "images")
    media = media_of(found, side)
    hashes = media.filter("phash is not null").select("path", "phash", "dhash")
    groups = materialise(similar.similar_groups(hashes, threshold, side * side), "similar-groups")
    info = materialise(file_info(found, media, oldest=priorities.oldest), "file-info")
    ranked = selection.ledger(selection.ranked(rivals(groups, info, "component"), priorities))
    return {
        "ledger": ranked,
        "percent": similar.similarity_to_first(groups, hashes, side * side),
        "info": info,
        "totals": similar.totals(groups),
        "unhashed": similar.unhashed_report(similar.unhashed(found, hashes).select("name", "ext")),
        "scanned": found.count(),
    }


def exact_ledger(spark: SparkSession, folders: list[str], section: str, *, extensions: list[str] | None = None, scan: Filters = DEFAULT_FILTERS, priorities: Priorities = Priorities()) -> DataFrame:
    """Exact duplicates of one section: its kinds, its engine. Pictures group
    across extensions; other files only with their own kind, after the size
    step."""
    wanted = extensions if extensions is not None else catalog.all_extensions(catalog.SECTIONS[section])
    found = materialise(kept_files(spark, folders, wanted, scan), "files")
    if section == "images":
        digests = found.join(source.streamed_hashes(found), "path")
        rows, keys = dedup.duplicate_rows(digests, by_extension=False), ["sha256"]
    else:
        rows, keys = dedup.duplicate_rows(dedup.hash_candidates(found)), ["ext", "sha256"]
    rows = materialise(rows.filter("sha256 is not null").withColumn("component", F.concat_ws("-", *keys)), "duplicates")
    if section == "video":
        date = dates.filename_timestamp(F.col("name"))
        videos = names.evidence(rows, "name", date).select(
            F.col("component").alias("grp"), "path", "name", "size", "mtime", F.col("video_provenance").alias("provenance"),
            F.coalesce(date, F.col("mtime")).alias("ts"), F.when(date.isNotNull(), "filename").otherwise("modified").alias("ts_source"),
        )
        return selection.ledger(selection.ranked_videos(videos))
    pictures = rows.filter(F.col("ext").isin(list(catalog.IMAGE)))
    info = file_info(rows, media_of(pictures, pixels=False), oldest=priorities.oldest, use_mtime=section != "images")
    return selection.ledger(selection.ranked(rivals(rows, info, "component"), priorities))


def corrupt_files(spark: SparkSession, folders: list[str], scan: Filters = DEFAULT_FILTERS) -> DataFrame:
    """(path, verdict) of the pictures that are corrupt or have no decoder."""
    media = media_of(kept_files(spark, folders, list(catalog.IMAGE), scan))
    return media.filter("verdict <> 'ok'").select("path", "verdict")
