"""Queries that run whole flows over the raw log lines, template mining included."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.catalog.base import register
from logweir.catalog.windows_and_features import r6
from logweir.detectors import linear_space as L
from logweir.functions import text as T
from logweir.operators import evaluation as E
from logweir.plans import flows, views as V

KEYED = flows.LogPreset(V.LOG_FORMAT, V.NUMBER_MASKS, 5, 0.5, train=0.8, seed=20)
TIMED = flows.LogPreset(
    V.LOG_FORMAT, V.NUMBER_MASKS, 3, 0.3, 1000, ("Date", "Time"), "yyyy.MM.dd HH:mm:ss", 3600, 900, train=0.6, merge_wildcards=True
)


def keyed(spark, sf):
    structured, _ = flows.mined_log(V.raw_lines(spark, sf), KEYED)
    keys = structured.select(F.explode(T.extract_session_keys(F.col("Content"))).alias("session_id"), T.binarize_label(F.col("Label")).alias("y"))
    labels = keys.groupBy("session_id").agg((F.avg("y") > 0.02).cast("int").alias("label"))
    return flows.keyed_sessions(structured, labels, KEYED)


def timed(spark, sf):
    structured, _ = flows.mined_log(V.raw_lines(spark, sf), TIMED)
    return flows.timed_sessions(structured, TIMED)


@register("keyed_log_masked_verdicts")
def keyed_log_masked_verdicts(spark, sf):
    return flows.masked_event_verdicts(keyed(spark, sf), 3, 0.5, 0.2)


@register("timed_log_masked_metrics")
def timed_log_masked_metrics(spark, sf):
    verdicts = flows.masked_event_verdicts(timed(spark, sf), 3, 0.5, 0.2)
    return E.classification_metrics(verdicts, "pred", "label")


@register("timed_log_next_event_sweep")
def timed_log_next_event_sweep(spark, sf):
    return flows.next_event_sweep(timed(spark, sf), 3, 3)


@register("timed_log_pca_verdicts")
def timed_log_pca_verdicts(spark, sf):
    train, test = flows.count_vectors(timed(spark, sf))
    return L.score_pca(test, L.fit_pca(train, 0.8, threshold=1.0)).select("session_id", "label", r6("spe").alias("spe"), "pred")


@register("keyed_log_detector_metrics")
def keyed_log_detector_metrics(spark, sf):
    """All detectors on count vectors of the mined log's sessions."""
    sessions = keyed(spark, sf)
    return flows.detector_metrics(sessions, ["residual", "clusters", "forest", "logistic", "margin", "tree"])
