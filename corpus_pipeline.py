"""The corpus pipeline: documents to shards, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. `run` writes each
result as Parquet into the folder that the cluster shares and reads it again, so a stage is computed once
and a lost executor costs tasks of one stage.

Defined cases: a null or blank text fails the base filter of the first stage and goes. Null ids, languages and
sources are kept as they are; a null source is a source of its own for the mix. Of rows equal in all columns the
second stage keeps one, and of equal or near texts the one of the least id, then of the least hash, so ties do not
depend on order. Very long texts are worked off whole. Extra columns, whatever their names, pass all stages but
the last. An empty table, or one of which nothing is kept, gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, quality, sharding, simhash
from tidemark.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def sharding_by_size(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_weights),
    ("sharding", sharding_by_size),
]

#: Expectation-maximisation, components and pivotal rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
