"""Numeric passes over dense vector tables: each task reduces its rows to one small matrix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

MAX_WIDTH = 4_096


def width_of(vectors: DataFrame, vector: str = "features") -> int:
    row = vectors.select(F.size(vector).alias("w")).first()
    if row is None:
        raise ValueError("no vectors")
    if row["w"] > MAX_WIDTH:
        raise ValueError(f"vectors of {row['w']} columns need more driver memory than a model may take")
    return row["w"]


def stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def sum_matrix(vectors: DataFrame, reduce_rows: Callable[[np.ndarray], np.ndarray], columns: list[str], shape: tuple[int, int]) -> np.ndarray:
    """Sum over tasks of ``reduce_rows`` applied to batches of rows; merging is spread by matrix row."""

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                part = reduce_rows(*[stack(pdf[c]) if pdf[c].dtype == object else pdf[c].to_numpy(np.float64) for c in columns])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(shape[0], dtype=np.int32), "row": list(total)})

    parts = vectors.select(*columns).mapInPandas(partial, "i int, row array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row"))
    out = np.zeros(shape)
    for r in sums.collect():
        out[r["i"]] = r["row"]
    return out


def gramian(vectors: DataFrame, width: int, vector: str = "features") -> tuple[np.ndarray, int]:
    """``X'X`` and the row count, in one pass."""

    def part(x: np.ndarray) -> np.ndarray:
        return np.vstack([x.T @ x, np.full((1, width), float(len(x)))])

    total = sum_matrix(vectors, part, [vector], (width + 1, width))
    return total[:width], int(total[width, 0])
