"""Fitted detectors as tables: one row per field, so that a model can be stored and read back."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import Any, TypeVar

import numpy as np
from pyspark.sql import SparkSession

from logweir.sources.writers import write_table

Model = TypeVar("Model")


def _plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return {"array": value.ravel().tolist(), "shape": value.shape}
    if isinstance(value, dict):
        return {"pairs": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if isinstance(value, tuple):
        return {"tuple": [_plain(v) for v in value]}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def _built(value: Any) -> Any:
    if isinstance(value, list):
        return [_built(v) for v in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], dtype=np.float64).reshape(value["shape"])
    if "pairs" in value:
        return {_built(k): _built(v) for k, v in value["pairs"]}
    return tuple(_built(v) for v in value["tuple"])


def write_model(spark: SparkSession, model: Any, path: str) -> str:
    """A fitted detector (subspace, invariants, clusters, forest, boundary, hypersphere) as a table ``field, value``."""
    rows = [(f.name, json.dumps(_plain(getattr(model, f.name)))) for f in fields(model)]
    return write_table(spark.createDataFrame(rows, "field string, value string").coalesce(1), path)


def read_model(spark: SparkSession, path: str, kind: type[Model]) -> Model:
    return kind(**{r["field"]: _built(json.loads(r["value"])) for r in spark.read.parquet(path).collect()})
