"""Event-count features, weights and summaries over long-form sessions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.functions.vectors import TINY, adaptive_avg_pool, sigmoid_nonzero
from logweir.operators.ordering import BROADCAST_ROWS, lookup, ordinal

# Vectors of a few kilobytes each: this many may be broadcast.
VECTOR_ROWS = 20_000


def event_counts(events: DataFrame, event: str = "event") -> DataFrame:
    """``session_id, event, n``; partial sums are formed before the shuffle."""
    return events.groupBy("session_id", F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class EventColumns:
    """Fitted columns: ``event, col, df`` in order of first appearance, and the number of sessions."""

    table: DataFrame
    sessions: int
    rows: int


def fit_event_columns(events: DataFrame, event: str = "event", min_count: int = 1, small: int = BROADCAST_ROWS) -> EventColumns:
    """Column order is first appearance over sessions; with ``min_count`` rarer events get no column."""
    per_session = events.groupBy("session_id", F.col(event).alias("event")).agg(F.min(F.struct("first_line", "session_id", "pos")).alias("_seen"))
    table = per_session.groupBy("event").agg(F.min("_seen").alias("_seen"), F.count(F.lit(1)).alias("df"))
    if min_count > 1:
        table = table.where(F.col("df") >= min_count)
    columns = ordinal(table, [F.asc("_seen")], "col", small=small).drop("_seen")
    sessions = events.where(F.col("pos") == 0).count()
    return EventColumns(columns, sessions, columns.count())


def align_to_training_events(counts: DataFrame, columns: EventColumns) -> DataFrame:
    """Keep the cells of fitted columns; everything else is an implicit zero."""
    return lookup(counts, columns.table.select("event", "col", "df"), ["event"], "inner", rows=columns.rows)


def oov_feature(counts: DataFrame, columns: EventColumns) -> DataFrame:
    """Distinct events without a column, per session."""
    known = columns.table.select("event", F.lit(1).alias("_known"))
    marked = lookup(counts, known, ["event"], rows=columns.rows)
    return marked.groupBy("session_id").agg(F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("oov"))


def tfidf_weight(cells: DataFrame, sessions: int, value: str = "n") -> DataFrame:
    """``n * ln(N / (df + 1e-8))`` with N and df from the fit."""
    return cells.withColumn("weight", F.col(value) * F.log(F.lit(float(sessions)) / (F.col("df") + TINY)))


@dataclass
class CountFeatures:
    """Count vectors with the fitted weighting and normalisation of a training set."""

    columns: EventColumns
    weighting: str | None = None
    normalization: str | None = None
    oov: bool = False
    oov_df: int = 0
    means: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.columns.rows + int(self.oov)

    def cells(self, events: DataFrame) -> DataFrame:
        """Stored cells ``session_id, col, value`` before centring."""
        counts = event_counts(events)
        cells = align_to_training_events(counts, self.columns).select("session_id", "col", "df", "n")
        if self.oov:
            extra = oov_feature(counts, self.columns).where(F.col("oov") > 0)
            cells = cells.unionByName(
                extra.select(
                    "session_id",
                    F.lit(self.columns.rows).cast("bigint").alias("col"),
                    F.lit(self.oov_df).cast("bigint").alias("df"),
                    F.col("oov").alias("n"),
                )
            )
        value = F.col("n").cast("double")
        if self.weighting == "tf-idf":
            value = value * F.log(F.lit(float(self.columns.sessions)) / (F.col("df") + TINY))
        if self.normalization == "sigmoid":
            value = sigmoid_nonzero(value)
        return cells.select("session_id", "col", value.alias("value"))

    def vectors(self, events: DataFrame) -> DataFrame:
        """``session_id, features`` as dense arrays; an array has one slot per fitted column.

        Cells travel in sparse form; a marker cell keeps sessions whose events all lack a column.
        """
        heads = events.where(F.col("pos") == 0).select("session_id", F.lit(-1).cast("bigint").alias("col"), F.lit(0.0).alias("value"))
        sparse = (
            self.cells(events)
            .unionByName(heads)
            .groupBy("session_id")
            .agg(F.collect_list("col").alias("cols"), F.collect_list("value").alias("values"))
        )
        width, means = self.width, np.zeros(self.width) if self.means is None else self.means

        @F.pandas_udf("array<double>")
        def dense(cols: pd.Series, values: pd.Series) -> pd.Series:
            out = np.zeros((len(cols), width + 1))
            lengths = cols.map(len).to_numpy()
            rows = np.repeat(np.arange(len(cols)), lengths)
            out[rows, np.concatenate(cols.to_numpy())] = np.concatenate(values.to_numpy())
            return pd.Series(list(out[:, :width] - means))

        return sparse.select("session_id", dense("cols", "values").alias("features"))


def fit_count_features(
    events: DataFrame, weighting: str | None = None, normalization: str | None = None, oov: bool = False, min_count: int = 1, max_width: int = 4_096
) -> CountFeatures:
    columns = fit_event_columns(events, min_count=min_count if oov else 1)
    if columns.rows > max_width:
        raise ValueError(f"{columns.rows} event columns do not fit dense vectors; use the long form cells")
    fitted = CountFeatures(columns, weighting, normalization, oov)
    if oov:
        fitted.oov_df = oov_feature(event_counts(events), columns).where(F.col("oov") > 0).count()
    if normalization == "zero-mean":
        fitted.means = np.zeros(fitted.width)
        for r in fitted.cells(events).groupBy("col").agg(F.sum("value").alias("total")).collect():
            fitted.means[r["col"]] = r["total"] / columns.sessions
    return fitted


def scale_times(events: DataFrame, fit_on: DataFrame, time: str = "delta_t", method: str = "minmax") -> DataFrame:
    """Scale delta times by minimum and range, or by mean and population deviation, of ``fit_on``."""
    if method == "minmax":
        fitted = fit_on.agg(F.min(time), F.max(time) - F.min(time))
    elif method == "standard":
        fitted = fit_on.agg(F.avg(time), F.stddev_pop(time))
    else:
        raise ValueError(method)
    shift, scale = fitted.first()
    return events.withColumn("scaled_t", (F.col(time) - F.lit(shift)) / F.lit(scale or 1.0))


def dataset_summary(sessions: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Totals, anomalies and normals per split, and over all splits."""
    return sessions.rollup(split).agg(
        F.grouping(split).alias("_all"),
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("anomalies"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("normals"),
    ).withColumn(split, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(split))).drop("_all")


def unknown_event_count(encoded: DataFrame, idx: str = "idx", unknown: int = 0) -> DataFrame:
    return encoded.agg(F.sum((F.col(idx) == unknown).cast("bigint")).alias("unknown_events"))


def prefix_anomaly_rate(lines: DataFrame, n: int, idx: str = "line_idx", label: str = "label") -> DataFrame:
    return lines.where(F.col(idx) < n).agg(F.count(F.lit(1)).alias("lines"), F.avg(label).alias("abnormal_rate"))


def sequence_length_distribution(sessions: DataFrame, label: str = "label") -> DataFrame:
    return sessions.groupBy(label, "n_events").agg(F.count(F.lit(1)).alias("sessions"))


def mean_vector_by_key(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Average vector per key, one partial sum per dimension before the shuffle."""
    sums = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dim)]
    return vectors.groupBy(key).agg(F.array(*sums).alias("mean_vector"))


def line_context_vector(
    placeholders: DataFrame, template_vectors: DataFrame, param_vectors: DataFrame, dim: int, bins: int = 256
) -> DataFrame:
    """Context of each line: mean over its placeholders of (template token vector + parameter vector) / 2, pooled.

    ``placeholders``: ``line_id, event_id, slot, param``, with a NULL slot on the line of a template
    without placeholders. Vectors are given tables keyed by ``(event_id, slot)`` and ``param``.
    """
    joined = lookup(placeholders, template_vectors.withColumnRenamed("vector", "_tv"), ["event_id", "slot"], small=VECTOR_ROWS)
    joined = lookup(joined, param_vectors.withColumnRenamed("vector", "_pv"), ["param"], small=VECTOR_ROWS)
    halves = [((F.get("_tv", F.lit(i)).cast("double") + F.get("_pv", F.lit(i)).cast("double")) / 2) for i in range(dim)]
    mean = F.array(*[F.avg(h) for h in halves])
    grouped = joined.groupBy("line_id").agg(mean.alias("_mean"), F.count("slot").alias("placeholders"))
    return grouped.select(
        "line_id", "placeholders", F.when(F.col("placeholders") > 0, adaptive_avg_pool(F.col("_mean"), bins)).alias("context")
    )
