"""A training corpus from raw documents: five operators in a row, each a stage of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracegrid.llm import byte_bpe, kneser_ney, mixing, near_dedup, quality_rules
from tracegrid.llm.workspace import materialize, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", kneser_ney.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Learned rules, a language model and a token file can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
