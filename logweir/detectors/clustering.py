"""Clustering of session vectors by angle: representatives, and distance to the nearest one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from logweir.functions.vectors import TINY
from logweir.operators.matching import nearest_representative
from logweir.session import materialise

BOOTSTRAP_ROWS = 1_000


@dataclass
class ClusterModel:
    representatives: np.ndarray
    sizes: np.ndarray
    rounds: int


def _distances(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1)
    d = 1 - (x @ x.T) / (np.outer(norms, norms) + TINY)
    d[d < TINY] = 0.0
    return d


def complete_linkage(x: np.ndarray, max_dist: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and sizes of complete-linkage clusters cut at ``max_dist``, for a bounded set of rows."""
    weights = np.ones(len(x)) if weights is None else np.asarray(weights, dtype=np.float64)
    d = _distances(x)
    np.fill_diagonal(d, np.inf)
    label = np.arange(len(x))
    while len(x) > 1:
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        if d[i, j] > max_dist:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        label[label == j] = i
    groups = [label == g for g in np.unique(label)]
    means = np.array([np.average(x[g], axis=0, weights=weights[g]) for g in groups])
    return means, np.array([weights[g].sum() for g in groups])


def fit_log_clustering(
    vectors: DataFrame,
    max_dist: float = 0.3,
    mode: str = "online",
    bootstrap: int = BOOTSTRAP_ROWS,
    order: tuple[str, ...] = ("first_line", "session_id"),
    vector: str = "features",
) -> ClusterModel:
    """Representatives by rounds.

    Equal vectors are counted once with a weight. The first rows in order are clustered as a whole;
    every other row joins its nearest representative if that is within ``max_dist`` (representatives
    move to the mean of their rows), and the first of the rows left over are clustered in turn, until
    none are left. Rows never meet in one task beyond the ``bootstrap`` rows of a round. The offline
    mode clusters all rows at once and is refused for more rows than a round takes.
    """
    at = F.struct(*order)
    distinct = materialise(
        vectors.groupBy(F.col(vector).alias("features")).agg(F.min(at).alias("at"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    if mode == "offline" and distinct.count() > bootstrap:
        raise ValueError("offline clustering takes one round of rows; use the online mode")
    left, reps, sizes, rounds = distinct, None, None, 0
    while True:
        head = left.orderBy("at").limit(bootstrap).collect()
        if not head:
            break
        rounds += 1
        means, counts = complete_linkage(np.array([r["features"] for r in head]), max_dist, np.array([r["weight"] for r in head]))
        reps = means if reps is None else np.vstack([reps, means])
        sizes = counts if sizes is None else np.concatenate([sizes, counts])
        if len(head) < bootstrap:
            break
        border = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(head[-1]["at"], distinct.schema["at"].dataType)])
        rest = materialise(nearest_representative(left.where(F.col("at") > border), reps))
        near = rest.where(F.col("distance") <= max_dist)
        sums = near.groupBy("rep").agg(
            F.sum("weight").alias("n"),
            vector_to_array(Summarizer.mean(array_to_vector("features"), F.col("weight"))).alias("mean"),
        )
        for r in sums.collect():
            k, n = r["rep"], r["n"]
            reps[k] = (reps[k] * sizes[k] + np.array(r["mean"]) * n) / (sizes[k] + n)
            sizes[k] += n
        left = rest.where(F.col("distance") > max_dist).select("features", "at", "weight")
    return ClusterModel(np.zeros((0, 0)) if reps is None else reps, np.zeros(0) if sizes is None else sizes, rounds)


def score_log_clustering(vectors: DataFrame, representatives: np.ndarray, threshold: float = 0.3, vector: str = "features") -> DataFrame:
    """Anomalous when the nearest representative is farther than ``threshold``."""
    near = nearest_representative(vectors, representatives, vector)
    return near.withColumn("pred", (F.col("distance") > threshold).cast("int"))
