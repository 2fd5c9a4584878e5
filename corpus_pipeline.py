"""Documents to packed training sequences: every stage writes Parquet that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.llm import decontamination, line_chunks, near_duplicates, packing, quality_rules
from logweir.llm.common import WORD, stored, table, without_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full policy accepts."""
    whole = docs.select(F.struct("*").alias("doc"), "text")
    return quality_rules.quality_ledger(whole, keep=["doc"]).where(quality_rules.passes("full-1")).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, without the line chunks that stand elsewhere before; those that lose all their words go.

    Chunks alone would leave the one-line chunks of a copy as a text of its own.
    """
    found = line_chunks.dedup_lines(without_copies(docs))
    lost = (F.col("removed_chunks") > 0) & ~F.col("kept").rlike(WORD)
    columns = [F.col(f"doc.`{c}`") for c in docs.columns]
    changed = found.where(~lost).select(*columns, F.col("kept").alias("_kept"), (F.col("removed_chunks") > 0).alias("_changed"))
    return changed.select(*[_after(c).alias(c) for c in docs.columns])


def _after(column: str) -> Column:
    if column == "text":
        return F.col("_kept")
    if column == "n_chars":
        return F.when(F.col("_changed"), F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return F.col(f"`{column}`")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_duplicates.without_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (0.8 of its five-word shingles)."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"), size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)
    return packing.pack(pieces, 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
