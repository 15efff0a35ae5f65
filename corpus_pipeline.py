"""The corpus pipeline: five stages over documents, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarifold.llm import hamming_join, mixing, packing, rule_list, site_bayes, token_rollup
from tarifold.llm.common import new_path, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is high enough."""
    return site_bayes.keep_good(spark, docs, sf_dir)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; the rules are learned on the whole documents table, as stage 1 leaves one class only."""
    return rule_list.keep_good(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return hamming_join.dedup(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken to meet the target weights in byte-pair tokens, once per epoch."""
    return mixing.mix(docs, tokens=token_rollup.token_counter(token_rollup.FIRST))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packs of the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mixing_to_weights),
    ("packing", sequence_packing),
]

#: The classifier, the learned rules and the signatures have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
