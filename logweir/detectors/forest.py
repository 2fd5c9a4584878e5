"""Isolation forest (Liu, Ting, Zhou 2008): trees grow side by side on small samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logweir.detectors.blocks import stack
from logweir.operators.ordering import exact_quantile

EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, cut double, low int, high int, depth double"


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.atleast_1d(np.asarray(n, dtype=np.float64))
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + EULER) - 2 * (n[big] - 1) / n[big]
    return out


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes ``(node, feature, cut, low, high, depth)``; a leaf has feature -1 and its path length."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    count = 1
    while todo:
        node, rows, depth = todo.pop()
        lo, hi = x[rows].min(0), x[rows].max(0)
        usable = np.flatnonzero(lo < hi)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(expected_path(len(rows))[0])))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(lo[feature], hi[feature]))
        below = x[rows, feature] <= cut
        nodes.append((node, feature, cut, count, count + 1, 0.0))
        todo += [(count, rows[below], depth + 1), (count + 1, rows[~below], depth + 1)]
        count += 2
    return nodes


@dataclass
class Forest:
    trees: list[np.ndarray]
    psi: int
    offset: float


def fit_isolation_forest(
    vectors: DataFrame,
    trees: int = 100,
    max_samples: int = 256,
    contamination: float | str = 0.03,
    seed: int = 19,
    key: str = "session_id",
    vector: str = "features",
) -> Forest:
    """Each tree gets the ``min(max_samples, n)`` rows with the smallest hash of seed, tree and id.

    A first pass over the ids alone finds for each tree the largest hash that still belongs to its sample; should its bound leave a tree short, it
    is doubled. The second pass takes the trees of a row by comparing its hashes with these limits, so a row's vector is read once and
    copied only to the trees whose sample it is in.
    """
    n = vectors.count()
    psi = min(max_samples, n)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    draws = F.transform(numbers, lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(key)).alias("_h")))
    bound = min(1.0, (psi + 8 * np.sqrt(psi)) / max(n, 1))
    order = Window.partitionBy("tree").orderBy("_h", key)
    while True:
        top = F.lit(min(int(bound * 2**64) - 2**63, 2**63 - 1))
        near = vectors.select(key, F.inline(F.filter(draws, lambda d: d["_h"] <= top)))  # noqa: B023
        smallest = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= psi)
        last = {r["tree"]: (r["n"], r["_h"]) for r in smallest.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("_h").alias("_h")).collect()}
        if bound == 1.0 or (len(last) == trees and all(k == psi for k, _ in last.values())):
            break
        bound = min(1.0, 2 * bound)
    limits = F.array(*[F.lit(last[t][1] if t in last else -(2**63)) for t in range(trees)])
    mine = F.filter(draws, lambda d: d["_h"] <= F.get(limits, d["tree"]))
    chosen = vectors.select(key, vector, mine.alias("_draws")).where(F.size("_draws") > 0).select(key, vector, F.inline("_draws"))
    dealt = chosen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= psi)
    limit = int(np.ceil(np.log2(max(psi, 2))))

    def grow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        nodes = grow_tree(stack(pdf[vector]), np.random.default_rng([seed, int(k[0])]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "low", "high", "depth"])
        out.insert(0, "tree", k[0])
        return out

    grown = dealt.select("tree", key, vector).groupBy("tree").applyInPandas(grow, NODES).toPandas()
    tables = []
    for _, t in grown.groupby("tree"):
        t = t.sort_values("node")
        tables.append(t[["feature", "cut", "low", "high", "depth"]].to_numpy(np.float64))
    forest = Forest(tables, psi, -0.5)
    if contamination != "auto":
        scored = with_forest_score(vectors.select(vector), forest, vector).select("score").persist()
        try:
            forest.offset = exact_quantile(scored, "score", float(contamination))
        finally:
            scored.unpersist()
    return forest


def with_forest_score(vectors: DataFrame, forest: Forest, vector: str = "features") -> DataFrame:
    """Add ``score`` = -2^(-mean path / expected path); lower is more unusual."""
    trees, base = forest.trees, float(expected_path(forest.psi)[0]) or 1.0

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = stack(values)
        total = np.zeros(len(x))
        for t in trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature = t[:, 0].astype(np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if len(inner) == 0:
                    break
                node = at[inner]
                below = x[inner, feature[node]] <= t[node, 1]
                at[inner] = np.where(below, t[node, 2], t[node, 3]).astype(np.int64)
            total += t[at, 4]
        return pd.Series(-np.power(2.0, -(total / len(trees)) / base))

    return vectors.withColumn("score", score(F.col(vector)))


def score_isolation_forest(vectors: DataFrame, forest: Forest, vector: str = "features") -> DataFrame:
    return with_forest_score(vectors, forest, vector).withColumn("pred", (F.col("score") < F.lit(float(forest.offset))).cast("int"))
