"""The queries of the training-data operators over the driver's tables, and the
SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfloom.llm import bpe, bytepair, decontam, exact_dedup, html_extract, langid, manifest, mixing, phrases, quality, secrets, simhash, warc
from shelfloom.llm.common import table


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_normalise": lambda s, d: warc.query(s, table(s, d, "pages")),
        "op2_html_main_text": lambda s, d: html_extract.query(s, table(s, d, "pages")),
        "op3_quality_classifier": lambda s, d: quality.query(s, table(s, d, "documents"), table(s, d, "labels")),
        "op4_simhash_near_dedup": lambda s, d: simhash.query(s, table(s, d, "documents")),
        "op5_language_id": lambda s, d: langid.query(s, table(s, d, "documents")),
        "op6_mixture_budget": lambda s, d: mixing.query(s, table(s, d, "documents")),
        "op7_benchmark_decontamination": lambda s, d: decontam.query(s, table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_token_counts": lambda s, d: bpe.query(s, table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
        "op9_exact_dedup": lambda s, d: exact_dedup.query(s, table(s, d, "documents")),
        "op10_secret_scan": lambda s, d: secrets.query(s, table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        "op11_phrase_collocations": lambda s, d: phrases.query(s, table(s, d, "documents")),
        "op12_merkle_manifest": lambda s, d: manifest.query(s, table(s, d, "documents")),
        "op13_byte_bpe": lambda s, d: bytepair.query(s, table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "pipeline": pipeline,
    }


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_normalise": WARC_SQL,
        "op6_mixture_budget": mixing.oracle(),
        "op9_exact_dedup": exact_dedup.ORACLE,
        "op11_phrase_collocations": phrases.ORACLE,
        "op12_merkle_manifest": manifest.ORACLE,
    }
