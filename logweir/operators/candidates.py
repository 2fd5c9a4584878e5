"""Candidate lists per context: the g best-scored events, and targets that are not among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from logweir.operators.ordering import lookup


def top_g_candidates(scores: DataFrame, g: int, context: Sequence[str], event: str = "event", score: str = "score") -> DataFrame:
    """The ``g`` best events of each context with their rank; equal scores by event.

    ``scores`` has one row per (context, event), so a context's group is at most the vocabulary.
    """
    order = Window.partitionBy(*context).orderBy(F.desc(score), F.asc(event))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= g)


def candidate_lists(scores: DataFrame, g: int, context: Sequence[str], event: str = "event", score: str = "score") -> DataFrame:
    """One row per context with its at most ``g`` candidates, best first."""
    ranked = top_g_candidates(scores, g, context, event, score)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(event).alias("e")))), lambda r: r["e"])
    return ranked.groupBy(*context).agg(listed.alias("candidates"))


def not_in_top_g(targets: DataFrame, candidates: DataFrame, context: Sequence[str], target: str, session: str = "session_id") -> DataFrame:
    """Per session: positions tried and targets absent from their context's candidates.

    ``candidates`` has one row per context. A context without candidates misses every target.
    """
    joined = lookup(targets, candidates, list(context))
    missed = ~F.coalesce(F.array_contains("candidates", F.col(target)), F.lit(False))
    return joined.groupBy(session).agg(
        F.count(F.lit(1)).alias("masked"), F.sum(missed.cast("bigint")).alias("undetected")
    )


def event_set_difference(a: DataFrame, b: DataFrame, event: str = "event") -> DataFrame:
    """Events of ``a`` that ``b`` lacks."""
    return a.select(event).distinct().join(b.select(event).distinct(), event, "left_anti")
