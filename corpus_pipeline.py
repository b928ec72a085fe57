"""Raw documents to token ids in five stages.

Every stage works on all that the one before it kept; the last writes token ids
in directly addressable codes and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborix.llm import decontaminate, mixing, quality_rules, simhash, token_ids
from arborix.session import shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("token_id_output", token_output),
]

#: EM, components and greedy tiling have no SQL form; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
