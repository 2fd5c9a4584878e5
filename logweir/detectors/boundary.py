"""One-class boundary with a radial kernel, through random Fourier features (Rahimi, Recht 2007)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.detectors.blocks import stack, sum_matrix, width_of
from logweir.operators.ordering import exact_quantile
from logweir.session import materialise


@dataclass
class Boundary:
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)


def scale_gamma(vectors: DataFrame, width: int, vector: str = "features") -> float:
    """1 / (columns * variance of all cells)."""

    def moments(x: np.ndarray) -> np.ndarray:
        return np.array([[x.size, x.sum(), (x * x).sum()]])

    n, s, q = sum_matrix(vectors, moments, [vector], (1, 3))[0]
    variance = q / n - (s / n) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def fit_one_class_svm(
    vectors: DataFrame, nu: float = 0.5, gamma: float | str = "scale", dims: int = 256, steps: int = 60, tolerance: float = 1e-3, seed: int = 7, vector: str = "features"
) -> Boundary:
    """Minimise ``|w|^2 / 2 - rho + mean(hinge(rho - w.z)) / nu``; rho is the nu-quantile of the scores.

    Equal vectors are counted once with a weight. Each step is one pass that sums the gradient and a
    histogram of the scores; for fixed w the best rho is the nu-quantile, taken from the pass before. Steps
    end when the weights move by less than ``tolerance`` of their length.
    """
    width = width_of(vectors, vector)
    g = scale_gamma(vectors, width, vector) if gamma == "scale" else float(gamma)
    rng = np.random.default_rng(seed)
    model = Boundary(rng.normal(scale=np.sqrt(2 * g), size=(width, dims)), rng.uniform(0, 2 * np.pi, dims), np.zeros(dims), 0.0)
    counted = materialise(vectors.groupBy(F.col(vector).alias("features")).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    # |w| is at most sqrt(2) / nu and |z| at most sqrt(2), so no score leaves the histogram.
    edges = np.linspace(-2 / nu, 2 / nu, 8_001)
    n = float(counted.agg(F.sum("weight")).first()[0])

    def one_pass(m: Boundary) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sum of the rows below rho, and the histogram of all scores."""

        def part(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            z = m.features(x)
            scores = z @ m.weights
            return np.concatenate([(w * (scores < m.rho)) @ z, np.histogram(scores.clip(edges[0], edges[-1]), edges, weights=w)[0]])[None, :]

        row = sum_matrix(counted, part, ["features", "weight"], (1, dims + len(edges) - 1))[0]
        return row[:dims], row[dims:]

    def quantile_of(histogram: np.ndarray) -> float:
        below = np.cumsum(histogram)
        return float(edges[min(int(np.searchsorted(below, nu * n)), len(edges) - 2) + 1])

    model.rho = np.inf
    model.weights = one_pass(model)[0] / n
    model.rho = quantile_of(one_pass(model)[1])
    for step in range(steps):
        pull, histogram = one_pass(model)
        change = (pull / (nu * n) - model.weights) * 2 / (step + 3)
        model = Boundary(model.frequencies, model.phases, model.weights + change, quantile_of(histogram))
        if np.linalg.norm(change) <= tolerance * np.linalg.norm(model.weights):
            break
    scored = with_boundary_score(vectors.select(vector), model, vector).select("score").persist()
    try:
        model.rho = exact_quantile(scored, "score", nu)
    finally:
        scored.unpersist()
    return model


def with_boundary_score(vectors: DataFrame, model: Boundary, vector: str = "features") -> DataFrame:
    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.features(stack(values)) @ model.weights)

    return vectors.withColumn("score", score(F.col(vector)))


def score_one_class_svm(vectors: DataFrame, model: Boundary, vector: str = "features") -> DataFrame:
    """1 outside the boundary, 0 inside."""
    return with_boundary_score(vectors, model, vector).withColumn("pred", (F.col("score") < F.lit(float(model.rho))).cast("int"))

