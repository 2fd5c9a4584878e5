"""Joins of token lists by what they share: an inverted index of rare elements finds the candidates, tasks verify them.

Rows are ``id, tokens, elements``. A left row that needs ``need`` elements in common with a right row must share one of its
``size - need + 1`` elements that are rarest on the right. Elements which no right row holds use up these places and list nothing, so
numbers and names inside messages cost little. Both sides stay DataFrames.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweir.functions.lcs import lcs_length, lcs_places


def token_key(tokens: Column) -> Column:
    """128 bits that stand for a token list."""
    return F.unhex(F.md5(F.to_json(F.struct(tokens.alias("t"))).cast("binary")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def numbered_tokens(tokens: pd.Series) -> pd.Series:
    """Each token with the number of its occurrence, so that sets of these intersect as the lists do with repeats."""

    def numbered(row) -> list[str]:
        seen: Counter = Counter()
        out = []
        for t in row:
            seen[t] += 1
            out.append(f"{seen[t]}\0{t}")
        return out

    return tokens.map(numbered)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def common_places(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places in ``b`` of the longest common subsequence with ``a``."""
    return pd.Series([lcs_places(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.LongType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence."""
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def candidates(left: DataFrame, right: DataFrame, need: Column) -> DataFrame:
    """``left_id, right_id`` of all pairs that share at least ``need`` (1 or more) elements, and some that share fewer.

    ``need`` is an expression over the left row; a row that needs more elements than it has finds none.
    """
    index = right.select(F.col("id").alias("right_id"), F.explode("elements").alias("element"))
    counts = index.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    spread = left.select(F.col("id").alias("left_id"), need.cast("int").alias("need"), F.explode("elements").alias("element"))
    ranked = spread.join(counts, "element", "left").groupBy("left_id", "need").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "element"))).alias("by_df")
    )
    places = F.greatest(F.lit(0), F.size("by_df") - F.col("need") + 1)
    rare = ranked.select("left_id", F.explode(F.slice("by_df", F.lit(1), places)).alias("e")).where("e.df > 0")
    return rare.select("left_id", F.col("e.element").alias("element")).join(index, "element").select("left_id", "right_id").distinct()


def sharing(left: DataFrame, right: DataFrame, need: Column, enough: Column) -> DataFrame:
    """Pairs as ``l`` and ``r`` (structs of the rows) for which ``enough`` holds; it may name ``l``, ``r`` and ``shared``, the number of common elements."""
    pairs = candidates(left, right, need)
    ls = left.select(F.col("id").alias("left_id"), F.struct("*").alias("l"))
    rs = right.select(F.col("id").alias("right_id"), F.struct("*").alias("r"))
    met = pairs.join(ls, "left_id").join(rs, "right_id")
    return met.withColumn("shared", F.size(F.array_intersect("l.elements", "r.elements"))).where(enough).select("l", "r")
