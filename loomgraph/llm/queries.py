"""Queries over the whole test tables, one per operator, in the form that their contracts name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import backoff, crf, cuckoo, jaccard, mixing, neighbours, packing, preferences, surrogates, warc
from loomgraph.llm.shared import new_path, stage


def tokenizer_path() -> str:
    """The public vocabulary file, from LOOMGRAPH_TOKENIZER or the installed collection."""
    if path := os.environ.get("LOOMGRAPH_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, least=0)
    #: Assembly reads the records several times; without payloads they are a small table.
    return warc.captures(stage(warc.read_warc(spark, path, payloads=False), "records"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preferences.conversations_to_turns(_table(spark, sf_dir, "conversations"))
    out = preferences.format_preferences(preferences.adjacent_pairs(convs))
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select(
        "pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_completion", "rejected_completion",
        trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_table(spark, sf_dir, "documents"))


def pieces(docs: DataFrame) -> DataFrame:
    packed = packing.pack(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents"), key=b"op8 production key")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return crf.identify(docs, crf.fit(docs))


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_preferences, op3_mixing, op4_exact_dedup, op5_embedding_dedup, op6_packing, op7_jaccard_join, op8_surrogates, op9_language_id, op10_backoff_lm)}
