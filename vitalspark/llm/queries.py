"""The operators' queries over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalspark.llm import (
    byte_bpe,
    centroids,
    fingerprint,
    html_text,
    lexical,
    line_dedup,
    lm,
    mixing,
    ngram_join,
    quality,
    secrets,
    sql,
    token_files,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.digest_query,
    "op2_token_files": token_files.files_query,
    "op3_lm_scoring": lm.lm_query,
    "op4_secrets": secrets.secrets_query,
    "op5_quality_rules": quality.quality_query,
    "op6_toxicity": toxicity.toxicity_query,
    "op7_html_text": html_text.pages_query,
    "op8_fingerprints": fingerprint.fingerprint_query,
    "op9_mixing": mixing.mixing_query,
    "op10_ngram_join": ngram_join.join_query,
    "op11_centroids": centroids.cluster_query,
    "op12_lexical_search": lexical.search_query,
    "op13_line_dedup": line_dedup.dedup_query,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLE_SQL.items() if k in QUERIES}
