"""Near-duplicate images: Hamming threshold join and its closure.

Pairs within the threshold are found by probing bands (``probing``), or where
that would take longer by comparing everything (``tiles``), with the same
result. Files with equal hashes are compared as one representative each and
attached to it afterwards, so a group of copies makes no quadratic output;
groups need a forest of links, not pairs.

Defined results: files without one of the hashes asked for are in no pair and
no group; a distance equal to the threshold matches; a path that comes twice
counts twice; no hashes give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.catalog import HEIF, RAW
from shelfloom.functions.hashing import hamming, similarity_pct
from shelfloom.functions.images import codecs
from shelfloom.operators import graph, probing, tiles
from shelfloom.runtime import materialise

#: Fixed value: how many names of unreadable files a report lists.
NAMED = 50


def _bit_text(words: str, bits: int) -> F.Column:
    """The hash as text of 0 and 1, 64 digits a word."""
    per = min(64, bits)
    text = F.transform(F.col(words), lambda w: F.lpad(F.bin(w), 64, "0"))
    return F.right(F.array_join(text, ""), F.lit(per * -(-bits // 64)))


def representatives(hashes: DataFrame, secondary: bool = True) -> DataFrame:
    """(rep, phash[, dhash]): the first path of each distinct hash."""
    keys = ["phash", "dhash"] if secondary else ["phash"]
    return hashes.dropna(subset=keys).groupBy(*keys).agg(F.min("path").alias("rep"))


def hamming_pairs(hashes: DataFrame, threshold: int, bits: int = 64, secondary: bool = True, forest: bool = False) -> DataFrame:
    """(a, b, distance[, distance2]) of representatives, a < b, within the
    threshold in every hash; with ``forest`` maybe fewer, which connect the
    same."""
    keys = ["phash", "dhash"] if secondary else ["phash"]
    reps = materialise(representatives(hashes, secondary), "representatives")
    bands = probing.plan(reps.count(), bits, threshold)
    if bands is None:
        return tiles.near_pairs(reps, threshold, keys, forest)
    return probing.near_pairs(reps, _bit_text("phash", bits), threshold, keys, bands, forest)


def similar_groups(hashes: DataFrame, threshold: int, bits: int = 64, secondary: bool = True) -> DataFrame:
    """(path, component) of every file that is in a group of two or more; the
    component is the group's first path."""
    keys = ["phash", "dhash"] if secondary else ["phash"]
    found = graph.components(hamming_pairs(hashes, threshold, bits, secondary, forest=True), "a", "b")
    reps = representatives(hashes, secondary)
    # by distinct hash: one row for any number of copies
    copies = hashes.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = copies.join(reps, keys).join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialise(placed.select(*keys, "component", "_n"), "placed")
    many = placed.groupBy("component").agg(F.sum("_n").alias("_all")).filter("_all > 1").select("component")
    named = materialise(placed.drop("_n").join(many, "component", "left_semi"), "groups")
    return hashes.select("path", *keys).join(named, keys).select("path", "component")


def totals(groups: DataFrame) -> DataFrame:
    """(similar, groups): how many files go if one of each group stays, and of
    how many groups."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("similar"), F.count(F.lit(1)).alias("groups"))


def similarity_to_first(groups: DataFrame, hashes: DataFrame, bits: int = 64) -> DataFrame:
    """(anchor, other, pct): every member against its group's first path."""
    primary = hashes.select("path", "phash")
    other = groups.join(primary, "path")
    anchor = primary.select(F.col("path").alias("component"), F.col("phash").alias("_first"))
    return (
        other.join(anchor, "component")
        .filter("path <> component")
        .select(F.col("component").alias("anchor"), F.col("path").alias("other"), similarity_pct(hamming(F.col("phash"), F.col("_first")), bits).alias("pct"))
    )


def unhashed(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Scanned files without a hash."""
    return files.join(hashes.select("path"), "path", "left_anti")


def unhashed_report(missing: DataFrame) -> dict:
    """What to say of ``missing`` (name, ext): how many there are, the first
    ``NAMED`` names, how many more, and the kinds of decoder that would help."""
    seen = missing.groupBy("ext").count().collect()  # one row an extension
    total, found = sum(r["count"] for r in seen), {(r.ext or "").lower() for r in seen}
    names = [r.name for r in missing.select("name").orderBy("name").limit(NAMED).collect()]
    hints = [kind for kind, extensions in (("raw", RAW), ("heif", HEIF)) if not codecs()[kind] and found & set(extensions)]
    return {"total": total, "names": names, "more": max(0, total - NAMED), "decoders": hints}
