"""Registered query of the language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import maxent_lm
from logweir.llm.common import table
from logweir.llm.registry import register


@register("op5_maxent_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))
