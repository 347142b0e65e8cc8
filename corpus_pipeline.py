"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import crf, cuckoo, jaccard, mixing
from loomgraph.llm.queries import pieces
from loomgraph.llm.shared import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.keep_identified(docs, crf.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cuckoo.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Learned weights decide the first stage and a vocabulary the last, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
