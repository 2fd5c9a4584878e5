"""Registered queries of the operators that lay documents out: shards, archives, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.llm import packing, sharding, token_files, warc
from logweir.llm.common import table
from logweir.llm.registry import register


@register("op1_minimax_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.minimax_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register("op10_warc_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, folder, payloads=False)


@register("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0), 2048)


@register("op13_elias_fano_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
