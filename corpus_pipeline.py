"""The corpus pipeline: five stages over documents, each written as a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, jaccard, language, mixing, quality
from tideline.llm._common import stored

STAGES = [
    ("language_id", language.stage),
    ("quality_rules", quality.stage),
    ("ngram_jaccard", jaccard.stage),
    ("source_mixing", mixing.stage),
    ("bpe_round_trip", bpe.stage),
]

#: Every stage rests on a trained model, set similarity over all rows or a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
