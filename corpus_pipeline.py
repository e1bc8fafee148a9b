"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, BPE.

Each stage reads what its predecessor wrote (Parquet in the shared folder), so a
lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalspark.llm import byte_bpe, mixing, ngram_join, quality, secrets
from vitalspark.llm.common import shared_path, table

STAGES = [
    ("quality_rules", quality.quality_stage),
    ("ngram_jaccard_join", ngram_join.near_stage),
    ("secret_scans", secrets.secrets_stage),
    ("mixing", mixing.mixing_stage),
    ("byte_bpe", byte_bpe.encode_stage),
]

#: SQL can express neither the byte-pair merges nor the mixing schedule; the
#: stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
