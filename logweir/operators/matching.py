"""Best match against a dictionary: templates by equal positions or subsequence, vectors by angle.

A dictionary of templates is a DataFrame of any size. An index of its rarest parts finds the candidates of each distinct message by
join, and only these are compared, so neither messages nor templates pass the driver. Representatives travel to the tasks in chunks of a fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweir.functions.lcs import lcs_template, lcs_tokens
from logweir.functions.text import WILDCARD
from logweir.functions.vectors import TINY
from logweir.operators.ordering import lookup
from logweir.operators.overlaps import common_length, sharing, token_key
from logweir.session import materialise

VECTOR_CHUNK = 4_096


def _fold(found: list[Column], none_type: str) -> Column:
    if not found:
        return F.lit(None).cast(none_type)
    return found[0] if len(found) == 1 else F.greatest(*found)


def _distinct_messages(messages: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame]:
    """The messages with the key of their tokens, and each key once with its tokens, stored."""
    keyed = messages.withColumn("_key", token_key(F.col(tokens)))
    once = keyed.where(F.size(tokens) > 0).groupBy(F.col("_key").alias("id")).agg(F.first(tokens).alias("tokens"))
    return keyed, once


def _placed(tokens: Column) -> Column:
    """Constants with their places and the number of tokens: what two lists of one length have in common at equal places."""
    n = F.size(tokens).cast("string")
    parts = F.transform(tokens, lambda t, i: F.when(t != WILDCARD, F.concat_ws(" ", n, i.cast("string"), t)))
    return F.filter(parts, lambda p: p.isNotNull())


def _with_best(keyed: DataFrame, best: DataFrame, columns: list[str]) -> DataFrame:
    found = materialise(best)
    joined = lookup(keyed, found.withColumnRenamed("id", "_key"), ["_key"], rows=found.count())
    return joined.select(*[c for c in keyed.columns if c != "_key"], *columns)


def match_templates(messages: DataFrame, dictionary: DataFrame, st: float, tokens: str = "tokens", order: str = "template_no") -> DataFrame:
    """Add ``template_no`` and ``similarity`` of the best template (NULL below ``st``).

    ``dictionary``: ``template_no`` in order of preference, ``template`` as a token array. The best template has the message's number of tokens, the
    largest share of equal constants, then more wildcards, then comes first. A message needs ``st`` of its tokens in common with a
    template, so it is looked up under its rarest (length, place, token) entries only, as many as a match cannot all miss.
    """
    keyed, once = _distinct_messages(messages, tokens)
    wild = lambda t: F.size(F.filter(t, lambda x: x == WILDCARD))
    left = materialise(once.withColumn("elements", _placed(F.col("tokens"))))
    right = dictionary.select(F.col(order).alias("id"), F.col("template").alias("tokens"), _placed(F.col("template")).alias("elements"))
    n = F.size("l.tokens")
    need = F.greatest(F.lit(1), F.ceil(F.size("tokens") * F.lit(float(st)) - F.lit(1e-9)))
    met = sharing(left, materialise(right), need, F.col("shared") / n >= F.lit(float(st)))
    found = [met.select(F.col("l.id").alias("id"), (F.size(F.array_intersect("l.elements", "r.elements")) / n).alias("s"), wild(F.col("r.tokens")).alias("w"), F.col("r.id").alias("no"))]
    if st <= 0:  # templates of the right length match without a constant in common
        size = F.size("template").alias("size")
        first = dictionary.groupBy(size, wild(F.col("template")).alias("w")).agg(F.min(order).alias("no")).groupBy("size").agg(F.max_by("no", "w").alias("no"), F.max("w").alias("w"))
        found.append(left.join(first, F.size("tokens") == F.col("size")).select("id", F.lit(0.0).alias("s"), "w", "no"))
    best = F.max(F.struct("s", "w", (-F.col("no")).alias("minus"))).alias("m")
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    matched = every.groupBy("id").agg(best).select("id", (-F.col("m.minus")).alias(order), F.col("m.s").alias("similarity"))
    return _with_best(keyed, matched, [order, "similarity"])


def match_templates_lcs(messages: DataFrame, dictionary: DataFrame, tau: float, share: float = 0.5, tokens: str = "tokens", order: str = "template_no") -> DataFrame:
    """Add the template with the longest common subsequence of at least ``tau`` of the message.

    Templates that have fewer different tokens in common with the message than ``share`` of its token count are not tried; on equal lengths the
    shorter template wins, then the earlier one. Candidates come from the message's tokens that are rarest in the dictionary.
    """
    keyed, once = _distinct_messages(messages, tokens)
    left = materialise(once.withColumn("elements", F.array_distinct("tokens")))
    right = materialise(dictionary.select(F.col(order).alias("id"), F.col("template").alias("tokens"), F.array_distinct("template").alias("elements")))
    need = F.greatest(F.lit(1), F.ceil(F.size("tokens") * F.lit(float(share)) - F.lit(1e-9)))
    n = F.size("l.tokens")
    met = sharing(left, right, need, F.col("shared") >= n * F.lit(float(share))).withColumn("common", common_length("l.tokens", "r.tokens"))
    best = F.max(F.struct("common", (-F.size("r.tokens")).alias("shorter"), (-F.col("r.id")).alias("minus"))).alias("m")
    matched = met.where(F.col("common") >= n * F.lit(float(tau))).groupBy(F.col("l.id").alias("id")).agg(best)
    return _with_best(keyed, matched.select("id", (-F.col("m.minus")).alias(order), F.col("m.common").alias("common")), [order, "common"])


def _angle_matcher(matrix: np.ndarray, first: int):
    """Nearest row by cosine distance as a struct of (negated distance, negated row number)."""
    norms = np.linalg.norm(matrix, axis=1)

    @F.pandas_udf("struct<near:double,neg_rep:bigint>")
    def best(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        d = 1 - (x @ matrix.T) / (np.linalg.norm(x, axis=1)[:, None] * norms[None, :] + TINY)
        d[d < TINY] = 0.0
        pick = d.argmin(1)
        return pd.DataFrame({"near": -d[np.arange(len(x)), pick], "neg_rep": -(pick + first)})

    return best


def nearest_representative(df: DataFrame, representatives: np.ndarray, vector: str = "features", chunk: int = VECTOR_CHUNK) -> DataFrame:
    """Add ``rep`` and ``distance`` of the closest representative; equal distances go to the earlier one."""
    reps = np.asarray(representatives, dtype=np.float64)
    found = [_angle_matcher(reps[i : i + chunk], i)(F.col(vector)) for i in range(0, len(reps), chunk)]
    return df.withColumn("_m", _fold(found, "struct<near:double,neg_rep:bigint>")).select(
        *df.columns, (-F.col("_m.neg_rep")).alias("rep"), (-F.col("_m.near")).alias("distance")
    )


TOKENS = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("common", TOKENS), T.StructField("template", TOKENS)]))
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Longest common subsequence of two token arrays, and ``b`` generalised by it."""
    common = [lcs_tokens(list(x), list(y)) for x, y in zip(a, b)]
    return pd.DataFrame({"common": common, "template": [lcs_template(c, list(y)) for c, y in zip(common, b)]})
