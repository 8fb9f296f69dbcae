"""A training-corpus pipeline over the documents table: every stage is one
operator of commentlake.llm and works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commentlake.llm import dart_minhash, mixing, quality_rules, secret_scan, sentencepiece_codec
from commentlake.llm.common import stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash_dedup", dart_minhash.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: Learned rules, signatures, a forest and a tokenizer: not SQL.  Tested against
#: brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
