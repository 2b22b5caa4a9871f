"""The driver's tables seen as a file library, in Spark and in DuckDB SQL.

A document is a file whose content is its text; its name takes one of thirteen
shapes by its id, so that every naming rule meets rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.runtime import table

_Y = "(2008 + doc_id % 14)"
_M, _D = "lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0')", "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')"
_H, _I = "lpad(CAST(doc_id % 24 AS STRING), 2, '0')", "lpad(CAST(doc_id * 7 % 60 AS STRING), 2, '0')"
_YMD, _HMS = f"{_Y} || {_M} || {_D}", f"{_H} || {_I} || '07'"
SHAPES = [
    f"'IMG_' || {_YMD} || '_' || {_HMS} || '.jpg'",
    "'photo (' || (doc_id % 40) || ').png'",
    "'Recovered_jpg_file(' || doc_id || ').jpg'",
    f"'report_' || {_YMD} || '.docx'",
    "'img_1280x853x24_' || doc_id || '.jpg'",
    "'Movie (' || (1990 + doc_id % 30) || ').mp4'",
    f"'WhatsApp Image ' || {_Y} || '-' || {_M} || '-' || {_D} || ' at ' || {_H} || '.' || {_I} || '.11.jpeg'",
    "'old_backup_edited ' || doc_id || '.tmp'",
    f"{_D} || '-' || {_M} || '-' || {_Y} || ' scan - copy.pdf'",
    f"'Screenshot_' || {_YMD} || '-' || {_HMS} || '.png'",
    "'clip_' || (doc_id % 7) || '.mov'",
    "'scan_' || (doc_id % 5)",
    f"CASE WHEN doc_id % 2 = 0 THEN '[' || {_YMD} || '].mp4' ELSE {_YMD} || '.mp4' END",
]
NAME = "CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SHAPES)) + " END"
HOURS = "(doc_id * 37 % 90000)"


def names(docs: DataFrame) -> DataFrame:
    return docs.withColumn("name", F.expr(NAME))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, ext, size, mtime, content, pixels, doc_id, text."""
    docs = names(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.expr("'/lib/' || source || '/' || CAST(doc_id AS STRING) || '/' || name").alias("path"),
        "name",
        F.concat(F.lit("."), "lang").alias("ext"),
        F.octet_length("text").cast("long").alias("size"),
        F.expr(f"timestampadd(HOUR, CAST({HOURS} AS INT), TIMESTAMP_NTZ '2012-01-01 00:00:00')").alias("mtime"),
        F.col("text").cast("binary").alias("content"),
        F.expr("n_chars * 1000").alias("pixels"),
        "text",
    )


#: The same as CTE text, to be followed by a SELECT.
FILES_SQL = f"""
WITH files AS (SELECT doc_id, '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '/' || name AS path, name,
    '.' || lang AS ext, CAST(strlen(text) AS BIGINT) AS size, TIMESTAMP '2012-01-01' + to_hours(CAST({HOURS} AS INT)) AS mtime,
    n_chars * 1000 AS pixels, text
  FROM (SELECT *, {NAME.replace("AS STRING", "AS VARCHAR")} AS name FROM documents))"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, phash, dhash of every embedding: its signs, and the signs of the
    steps between neighbours."""
    from shelfloom.functions.hashing import sign_words

    e = table(spark, sf_dir, "embeddings")
    v: Column = F.transform("embedding", lambda x: x.cast("double"))  # 64 components: sign_words raises on others
    turned = F.concat(F.slice(v, 2, 63), F.slice(v, 1, 1))
    steps = F.zip_with(v, turned, lambda a, b: a - b)
    return e.select(F.format_string("v%06d", "vec_id").alias("path"), sign_words(v).alias("phash"), sign_words(steps).alias("dhash"))


HASHES_SQL = """
WITH raw AS (SELECT printf('v%06d', vec_id) AS path, list_transform(embedding[1:64], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
hashes AS (SELECT path, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS p,
    array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN v[i] - v[i % 64 + 1] > 0 THEN '1' ELSE '0' END), '') AS q FROM raw)"""
