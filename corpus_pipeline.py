"""Corpus pipeline: the documents that are fit for training, near copies and benchmark text removed, encoded.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; its result is
written as Parquet in the shared checkpoint folder and read again. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftlens.llm import stages
from shiftlens.llm.common import Scratch

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("decontamination", stages.decontamination),
    ("bpe", stages.bpe),
]

#: The stages learn from the data and call tokenizer rules, which SQL cannot express; the tests
#: compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages, and the operators in them, wrote on the way is deleted at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, collect=True) as scratch:
        for name, step in STAGES:
            docs = scratch.stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.keep(docs)
    return docs
