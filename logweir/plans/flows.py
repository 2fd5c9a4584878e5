"""Whole flows from raw log lines to session verdicts and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from logweir.detectors import boundary, clustering, forest, linear_space, supervised
from logweir.detectors.context_counts import (
    fit_next_event,
    masked_event_detector,
    next_event_detector,
    next_event_results,
    score_next_event,
)
from logweir.functions import text as T
from logweir.operators.dictionaries import apply_event_rank, event_rank
from logweir.operators.evaluation import classification_metrics, session_verdict, threshold_sweep
from logweir.operators.features import fit_count_features
from logweir.operators.mining import drain_templates, mining_result
from logweir.operators.ordering import spread_join
from logweir.operators.parsing import match_log_format
from logweir.operators.sessions import join_session_labels, session_heads, sessionize, sessionize_by_key
from logweir.operators.splits import TRAIN, mix_abnormal_into_train, split_normal_abnormal, take_prefix
from logweir.operators.windows import chunk_sequence, next_event_windows, sliding_time_window_events
from logweir.session import materialise


def ranked_sessions(lines: DataFrame, log_format: str, masks: Sequence[str]) -> DataFrame:
    """Raw lines to sessions of event ranks: parse, mask, rank templates, group by the keys in the text.

    The parsed log is stored without its text and the sessions are stored once, so the patterns run
    once per line although ranks, positions, fit and score all read them.
    """
    log = match_log_format(lines, log_format).withColumn("event_id", T.template_id(T.mask_variables(F.col("Content"), masks)))
    keys = T.extract_session_keys(F.col("Content"))
    log = materialise(log.select("line_no", "event_id", T.binarize_label(F.col("Label")).alias("line_label"), keys.alias("keys")))
    occurrences = log.groupBy("event_id").agg(F.count(F.lit(1)).alias("occurrences"))
    ranked = apply_event_rank(log, event_rank(occurrences)).withColumn("event", F.col("event_rank").cast("string"))
    keyed = ranked.withColumn("session_id", F.explode("keys")).select("session_id", "line_no", "event", "line_label")
    return materialise(sessionize(keyed, line="line_no", totals={"label": ("max", "line_label")}))


def unusual_successors(sessions: DataFrame, width: int = 1, g: int = 3, threshold: float = 0.5) -> DataFrame:
    """Verdict per session from unexpected next events; the scorer is fitted on normal sessions."""
    windows = next_event_windows(sessions.select("session_id", "pos", "n_events", "event", "label"), width)
    model = fit_next_event(windows.where(F.col("label") == 0), width, g)
    results = next_event_results(score_next_event(windows, model, width, count_pad_target=False))
    return session_verdict(results, threshold, "logkey_anomaly", "predicted_logkey")


def flow_metrics(verdicts: DataFrame) -> DataFrame:
    return classification_metrics(verdicts, "pred", "label")


@dataclass(frozen=True)
class LogPreset:
    """How one kind of log is parsed, mined, grouped and split."""

    log_format: str
    masks: tuple[str, ...]
    depth: int
    st: float
    max_child: int = 100
    time_fields: tuple[str, ...] = ()
    time_pattern: str = ""
    window: int = 0
    step: int = 0
    train: float = 0.8
    seed: int = 12
    prefix_lines: int | None = None
    merge_wildcards: bool = False


# Settings per public log collection (train from 1 on is a number of sessions).
HDFS = LogPreset(T.HDFS_FORMAT, T.HDFS_MASKS, 5, 0.5, train=0.8, seed=20)
BGL = LogPreset(T.BGL_FORMAT, T.BGL_MASKS, 3, 0.3, time_fields=("Time",), time_pattern="yyyy-MM-dd-HH.mm.ss.SSSSSS", window=300, step=60, train=0.6, merge_wildcards=True)
THUNDERBIRD = LogPreset(
    T.THUNDERBIRD_FORMAT, T.THUNDERBIRD_MASKS, 3, 0.3, 1000, ("Date", "Time"), "yyyy.MM.dd HH:mm:ss", 60, 30, train=6000
)


def mined_log(lines: DataFrame, preset: LogPreset) -> tuple[DataFrame, DataFrame]:
    """Raw ``line_no, line`` to the structured log with event ranks, and the template dictionary."""
    if preset.prefix_lines is not None:
        lines = take_prefix(lines, preset.prefix_lines, idx="line_no")
    log = match_log_format(lines, preset.log_format).withColumnRenamed("line_no", "line_id")
    tokens = T.tokenize_ws(T.mask_variables(F.col("Content"), preset.masks))
    stored = materialise(log.withColumn("tokens", tokens))
    mined = drain_templates(stored, preset.depth, preset.st, preset.max_child)
    structured, dictionary = mining_result(mined.drop("tokens"), across_spaces=preset.merge_wildcards)
    dictionary = materialise(dictionary)
    ranked = apply_event_rank(structured.drop("cluster", "cluster_template"), event_rank(dictionary))
    return materialise(ranked.withColumn("event", F.col("event_rank").cast("string"))), dictionary


def keyed_sessions(structured: DataFrame, labels: DataFrame, preset: LogPreset) -> DataFrame:
    """Sessions by the keys in the text, with the labels of a label table and the split of each session.

    A session without a label is in no split and is left out.
    """
    found = materialise(sessionize_by_key(structured.select("line_id", "Content", "event")).drop("Content"))
    heads = join_session_labels(session_heads(found).select("session_id", "n_events"), labels)
    return _with_split(found, heads, preset)


def timed_sessions(structured: DataFrame, preset: LogPreset) -> DataFrame:
    """Sliding-window sessions with the label of the lines and the split of each window."""
    stamp = F.concat_ws(" ", *preset.time_fields)
    log = structured.select(
        "line_id", "event", T.parse_log_time(stamp, preset.time_pattern).alias("ts_sec"), T.binarize_label(F.col("Label")).alias("label")
    )
    found = sliding_time_window_events(materialise(log), preset.window, preset.step)
    first = (F.col("line_idx") - F.col("pos")).alias("first_line")
    kept = ["session_id", "pos", "n_events", "line_id", "event", "delta_t", first, F.col("session_label").alias("label")]
    found = materialise(found.select(*kept))
    return _with_split(found.drop("label"), session_heads(found).select("session_id", "n_events", "label"), preset)


def _with_split(events: DataFrame, heads: DataFrame, preset: LogPreset) -> DataFrame:
    split = split_normal_abnormal(heads, preset.train, preset.seed).select("session_id", "label", "split", "n_events")
    return materialise(spread_join(events.drop("n_events"), split, ["session_id"], "pos", "n_events"))


def train_part(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("split") == TRAIN)


def test_part(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("split") != TRAIN)


test_part.__test__ = False


def masked_event_verdicts(sessions: DataFrame, g: int, mask_ratio: float, threshold: float, seed: int = 1, seq_len: int | None = None, min_len: int = 0) -> DataFrame:
    """Mask, predict from both sides, and judge each test session by its share of unexpected events.

    ``min_len`` keeps short sessions out of the fit; every test session is judged.
    """

    def cut_part(part: DataFrame, least: int) -> DataFrame:
        cut = chunk_sequence(part, adaptive=True, seq_len=seq_len, min_len=least).drop("chunk", "chunk_pos")
        return cut if seq_len is None else cut.withColumn("n_events", F.least("n_events", F.lit(seq_len)))

    results = masked_event_detector(cut_part(train_part(sessions), min_len), cut_part(test_part(sessions), 0), g, mask_ratio, seed)
    return session_verdict(results, threshold, "undetected_tokens", "masked_tokens")


def next_event_sweep(sessions: DataFrame, width: int = 10, g: int = 9, min_len: int = 0) -> DataFrame:
    """Next-event detector with thresholds 0..9 on its miss counts; ``min_len`` keeps short sessions out of the fit only."""
    train = train_part(sessions).where(F.col("n_events") >= min_len)
    return threshold_sweep(next_event_detector(train, test_part(sessions), width, g), undetected="logkey_anomaly")


def count_vectors(sessions: DataFrame, weighting: str | None = None, normalization: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Count vectors of the training and test sessions for the vector detectors."""
    fitted = fit_count_features(train_part(sessions), weighting, normalization)

    def part(events: DataFrame) -> DataFrame:
        return materialise(fitted.vectors(events).join(session_heads(events).select("session_id", "label", "first_line"), "session_id"))

    return part(train_part(sessions)), part(test_part(sessions))


def mixed_count_vectors(sessions: DataFrame, seed: int = 1, weighting: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Count vectors for supervised detectors: some of the abnormal sessions are moved to the training side."""
    sides = materialise(mix_abnormal_into_train(session_heads(sessions).select("session_id", "label", "first_line", "n_events", "split"), seed))
    trained = sides.where(F.col("side") == TRAIN).select("session_id", "n_events")
    events = spread_join(sessions.drop("n_events"), trained, ["session_id"], "pos", "n_events")
    fitted = fit_count_features(events, weighting)
    both = materialise(fitted.vectors(sessions).join(sides.select("session_id", "label", "first_line", "side"), "session_id"))
    return both.where(F.col("side") == TRAIN), both.where(F.col("side") != TRAIN)


def _residual(sessions: DataFrame) -> DataFrame:
    train, test = count_vectors(sessions, "tf-idf", "zero-mean")
    return linear_space.score_pca(test, linear_space.fit_pca(train))


def _invariants(sessions: DataFrame) -> DataFrame:
    train, test = count_vectors(sessions)
    return linear_space.score_invariants(test, linear_space.fit_invariants(train))


def _clusters(sessions: DataFrame) -> DataFrame:
    train, test = count_vectors(sessions, "tf-idf")
    return clustering.score_log_clustering(test, clustering.fit_log_clustering(train).representatives)


def _forest(sessions: DataFrame) -> DataFrame:
    train, test = count_vectors(sessions)
    return forest.score_isolation_forest(test, forest.fit_isolation_forest(train))


def _boundary(sessions: DataFrame) -> DataFrame:
    train, test = count_vectors(sessions)
    return boundary.score_one_class_svm(test, boundary.fit_one_class_svm(train))


#: Detectors on count vectors by name, each from split sessions to verdicts of the test sessions.
DETECTORS = {
    "residual": _residual,
    "invariants": _invariants,
    "clusters": _clusters,
    "forest": _forest,
    "boundary": _boundary,
    "logistic": lambda sessions: supervised.logistic_regression(*mixed_count_vectors(sessions)),
    "margin": lambda sessions: supervised.linear_svm(*mixed_count_vectors(sessions)),
    "tree": lambda sessions: supervised.decision_tree(*mixed_count_vectors(sessions)),
}


def detector_verdicts(sessions: DataFrame, detector: str) -> DataFrame:
    """``session_id, label, pred`` of the test sessions under one of ``DETECTORS``, fitted on the training sessions."""
    return DETECTORS[detector](sessions).select("session_id", "label", "pred")


def detector_metrics(sessions: DataFrame, detectors: Sequence[str] = tuple(DETECTORS)) -> DataFrame:
    """Precision, recall and F1 of each detector, one row each."""
    rows = [flow_metrics(detector_verdicts(sessions, d)).withColumn("detector", F.lit(d)) for d in detectors]
    return reduce(DataFrame.unionByName, rows)
