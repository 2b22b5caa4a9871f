"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: after at least ``MIN_CHUNK``
characters, at the first of a few letter-and-blank patterns, or at
``MAX_CHUNK``. Each distinct chunk gets an identifier: the chunk's 64-bit hash,
verified against its SHA-256 over all chunks of the table; where two different
chunks share a hash, the second and later ones get identifiers of their own. A
text's recipe is the ordered list of its chunks' identifiers, and equal recipes
are equal texts. No text is moved: chunks are hashed where they are read, and
what is shuffled are hashes with the least and greatest digest that go with
them, and recipes.

Defined results: null counts as the empty text, whose recipe is empty; equal
texts keep the row with the largest id; a null id is kept only where all ids of
the text are null; an empty table gives no rows. The query calls every row that
repeats the kept id and text kept, as it has no other name for one; the stage
leaves one of them, as of any group, whatever its ids. Texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm.common import materialise, one_row_each, renamed

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: A cut after any of these letter pairs and a blank; what is left at the end is the last chunk.
CUT = "(?s).{%d,%d}?(?<=[aeiou][dlnrst][ \\n]|[.!?] )|.{1,%d}" % (MIN_CHUNK, MAX_CHUNK - 1, MAX_CHUNK)


def chunks(text: F.Column, cut: str = CUT) -> F.Column:
    """Array of the text's chunks; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_hash(chunk: F.Column) -> F.Column:
    return F.xxhash64(chunk)


def chunk_store(rows: DataFrame) -> DataFrame:
    """(_h, _sha): the chunks of ``rows`` (_pieces) that the bare hash does not
    name, as another chunk with a lesser digest has it. One shuffle of hashes,
    combined before it, tells whether there are any."""
    seen = rows.select(F.explode("_pieces").alias("_c")).select("_c._h", "_c._sha")
    shared = seen.groupBy("_h").agg(F.min("_sha").alias("_first"), F.max("_sha").alias("_last")).filter("_first <> _last")
    shared = materialise(shared.select("_h", "_first"), "chunk-collisions")
    if shared.isEmpty():
        return shared.select("_h", F.col("_first").alias("_sha"))
    return seen.join(shared, "_h").filter("_sha <> _first").select("_h", "_sha").distinct()


def recipes(docs: DataFrame, *, id_col: str, text_col: str, hasher=chunk_hash, cut: str = CUT) -> DataFrame:
    """(_id, _digest, _recipe) of every row: the digest of the whole text (32
    bytes) and the ordered list of verified identifiers."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = renamed(docs, _id=id_col, _text=text_col).select(
        "_id",
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.transform(chunks(text, cut), lambda c: F.struct(hasher(c).alias("_h"), F.unhex(F.sha2(c, 256)).alias("_sha"))).alias("_pieces"),
    )
    rows = materialise(rows, "recipes")
    odd = chunk_store(rows)
    plain = F.transform("_pieces", lambda p: p["_h"].cast("string"))
    if odd.isEmpty():
        return rows.select("_id", "_digest", plain.alias("_recipe"))
    # Collided chunks are named by hash and digest, in the texts that hold them.
    held = rows.select("_digest", F.explode("_pieces").alias("_c")).select("_digest", "_c._h", "_c._sha").distinct()
    named = held.join(odd, ["_h", "_sha"]).groupBy("_digest").agg(F.collect_set("_sha").alias("_odd"))
    exact = F.transform(
        "_pieces",
        lambda p: F.when(F.array_contains(F.coalesce("_odd", F.array().cast("array<binary>")), p["_sha"]), F.concat_ws(":", p["_h"].cast("string"), F.hex(p["_sha"]))).otherwise(p["_h"].cast("string")),
    )
    return rows.join(named, "_digest", "left").select("_id", "_digest", exact.alias("_recipe"))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hasher=chunk_hash, cut: str = CUT) -> DataFrame:
    """(_id, _keep, _size, _digest) of every row."""
    rows = recipes(docs, id_col=id_col, text_col=text_col, hasher=hasher, cut=cut)
    # The list of identifiers is the key. Equal lists combine before the shuffle;
    # the groups are written, so that the join back may be split where one is hot.
    rows = rows.withColumn("_recipe", F.concat_ws(",", "_recipe"))
    kept = rows.groupBy(F.col("_recipe").alias("_r")).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    kept = materialise(kept, "recipe-groups")
    return rows.join(kept, F.col("_recipe") == F.col("_r")).select("_id", "_keep", "_size", "_digest")


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return groups(documents).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def keep_largest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, that of the largest id, with all its columns."""
    found = groups(docs, id_col=id_col, text_col=text_col)
    decided = found.select("_id", "_digest", F.col("_id").eqNullSafe(F.col("_keep")).alias("_stays"))
    return one_row_each(docs, decided, id_col=id_col, text_col=text_col)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
