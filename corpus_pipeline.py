"""From raw documents to training order: quality rules, near-duplicates, benchmark passages, source mix, shards.

Each stage reads what the one before it has written, works on all of it, and returns the columns of ``documents``; the last
returns the records of the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnframe.llm import op1_quality, op3_order, op5_near, op7_decontaminate, op10_mix
from cairnframe.llm.common import documents, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified rule reject go."""
    return op1_quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return op5_near.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    return op7_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate has it."""
    return op10_mix.mix(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in their global slots."""
    return op3_order.records(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("training order", training_order),
]

#: Latent retrieval and tokenisation are beyond SQL; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
