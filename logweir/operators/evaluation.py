"""Session verdicts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweir.functions.vectors import TINY


def confusion(df: DataFrame, pred: str, truth: str) -> DataFrame:
    def cell(p: int, t: int) -> F.Column:
        return F.coalesce(F.sum(((F.col(pred) == p) & (F.col(truth) == t)).cast("bigint")), F.lit(0))

    return df.agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fn"))


def with_scores(counts: DataFrame, guarded: bool = False, digits: int = 4) -> DataFrame:
    """Precision, recall and F1 in percent; NULL where undefined, unless the tiny guard is asked for."""
    add = TINY if guarded else 0.0

    def ratio(hits, total):
        return F.when(total + add != 0, 100.0 * hits / (total + add))

    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    total = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total))
    return out.select("*").withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def classification_metrics(df: DataFrame, pred: str = "pred", truth: str = "truth", guarded: bool = True, digits: int = 4) -> DataFrame:
    return with_scores(confusion(df, pred, truth), guarded, digits)


def session_verdict(
    results: DataFrame,
    threshold: float | int,
    undetected: str = "undetected",
    masked: str = "masked",
    ratio: bool = True,
    hypersphere: str | None = None,
    out: str = "pred",
) -> DataFrame:
    """Anomalous when misses exceed a share of the tried positions, or a plain count, or the vector test fired."""
    limit = F.col(masked) * F.lit(float(threshold)) if ratio else F.lit(threshold)
    hit = F.col(undetected) > limit
    if hypersphere:
        hit = hit | (F.col(hypersphere) == 1)
    return results.withColumn(out, hit.cast("int"))


def session_rollup(windows: DataFrame, anomaly: str = "anomaly", label: str = "label") -> DataFrame:
    """Any anomalous window makes the session anomalous; its label is the largest."""
    return windows.groupBy("session_id").agg(
        F.max((F.col(anomaly) > 0).cast("int")).alias("pred"), F.max((F.col(label) > 0).cast("int")).alias("truth")
    )


def window_accuracy(windows: DataFrame, pred: str = "pred_event", target: str = "next_event") -> DataFrame:
    return windows.agg(F.avg((F.col(pred) == F.col(target)).cast("double")).alias("window_acc"), F.count(F.lit(1)).alias("windows"))


def threshold_sweep(
    results: DataFrame, thresholds: int = 10, undetected: str = "undetected", truth: str = "label"
) -> DataFrame:
    """Scores at thresholds 0..n-1, without those that find nothing; rows are first reduced to miss counts."""
    by_misses = results.groupBy(F.col(truth).alias("truth"), F.col(undetected).alias("misses")).agg(F.count(F.lit(1)).alias("n"))
    tried = by_misses.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))))
    hit = F.col("misses") > F.col("threshold")

    def cell(pred, t):
        return F.sum(F.when(pred & (F.col("truth") == t), F.col("n")).otherwise(0))

    counts = tried.groupBy("threshold").agg(
        cell(hit, 1).alias("tp"), cell(hit, 0).alias("fp"), cell(~hit, 0).alias("tn"), cell(~hit, 1).alias("fn")
    )
    return with_scores(counts.where(F.col("tp") > 0))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best F1."""
    best = F.max_by(F.struct(*sweep.columns), F.struct(F.col("f1"), -F.col("threshold")))
    return sweep.agg(best.alias("_b")).select("_b.*")
