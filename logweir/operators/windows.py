"""Time windows and windows over session events, in long form."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.sequences import count_by_item
from logweir.operators.dictionaries import WINDOW_SPECIALS
from logweir.operators.ordering import BLOCK_ROWS, dense_position, lookup, scan_log, with_neighbours
from logweir.session import materialise

PAD_EVENT = WINDOW_SPECIALS[1]


def _bounds(log: DataFrame, line: str, time: str) -> tuple[int, int]:
    """Time of the first line and latest time: one pass over two columns, two numbers to the driver."""
    first = log.agg(F.min_by(time, line), F.max(time)).first()
    if first[1] is None:
        raise ValueError("empty log")
    return first[0], first[1]


def _window_span(log: DataFrame, window: int, step: int, line: str, time: str) -> tuple[int, int]:
    """Start time, and the number of the first window that reaches past the last line."""
    t0, t1 = _bounds(log, line, time)
    return t0, max(0, (t1 - t0 - window) // step + 1)


def _windows_of(offset: Column, window: int, step: int, last: int) -> Column:
    """Window numbers holding a given offset from the first line's time; empty for lines after the last window."""
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((offset - window) / step) + 1)
    until = F.least(F.lit(last).cast("bigint"), F.floor(offset / step))
    return F.when(first <= until, F.sequence(first, until))


def sliding_time_windows(
    log: DataFrame,
    window: int,
    step: int,
    line: str = "line_id",
    time: str = "ts_sec",
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
    collapse: bool = True,
) -> DataFrame:
    """Half-open windows ``[t0 + k S, t0 + k S + W)`` over the log in line order.

    One row per window: ``k, first_idx, last_idx, n_events, label``. No window starts after the first
    one that reaches past the last row; empty windows are absent; windows of the same lines collapse.
    Rows are summed per pane (the common divisor of window and step) before panes go to windows.
    """
    start, last = _window_span(log, window, step, line, time)
    return _sliding(log, window, step, start, last, line, time, label, block_rows, collapse)


def _sliding(
    log: DataFrame, window: int, step: int, start: int, last: int, line: str, time: str, label: str, block_rows: int, collapse: bool
) -> DataFrame:
    if step > window:
        raise ValueError("step larger than the window")
    pane = gcd(window, step)
    scanned = scan_log(log, line, time, block_rows)
    panes = (
        scanned.withColumn("_offset", F.floor((F.col("time_so_far") - start) / pane) * pane)
        .groupBy("_offset")
        .agg(
            F.min("line_idx").alias("first_idx"),
            F.max("line_idx").alias("last_idx"),
            F.count(F.lit(1)).alias("n_events"),
            F.max(label).alias("label"),
        )
    )
    windows = (
        panes.withColumn("_span", _windows_of(F.col("_offset"), window, step, last))
        .withColumn("k", F.explode("_span"))
        .groupBy("k")
        .agg(
            F.min("first_idx").alias("first_idx"),
            F.max("last_idx").alias("last_idx"),
            F.sum("n_events").alias("n_events"),
            F.max("label").alias("label"),
        )
    )
    if not collapse:
        return windows
    return (
        windows.groupBy("first_idx", "last_idx")
        .agg(F.min("k").alias("k"), F.first("n_events").alias("n_events"), F.first("label").alias("label"))
        .select("k", "first_idx", "last_idx", "n_events", "label")
    )


def sliding_time_window_events(
    log: DataFrame,
    window: int,
    step: int,
    line: str = "line_id",
    time: str = "ts_sec",
    label: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Events of every sliding window: ``session_id, pos, n_events, session_label, delta_t`` plus the log columns."""
    start, last = _window_span(log, window, step, line, time)
    windows = _sliding(log, window, step, start, last, line, time, label, block_rows, True)
    lines = (
        scan_log(log, line, time, block_rows)
        .withColumn("_span", _windows_of(F.col("time_so_far") - start, window, step, last))
        .withColumn("k", F.explode("_span"))
        .withColumn("_part", F.floor(F.col("line_idx") / block_rows))
    )
    parts = windows.withColumn(
        "_part", F.explode(F.sequence(F.floor(F.col("first_idx") / block_rows), F.floor(F.col("last_idx") / block_rows)))
    ).withColumnRenamed("label", "session_label")
    kept = [c for c in log.columns if c not in (label,)]
    return (
        lines.join(parts, ["k", "_part"])
        .withColumn("pos", F.col("line_idx") - F.col("first_idx"))
        .select(
            F.col("k").alias("session_id"),
            "pos",
            "n_events",
            "session_label",
            "line_idx",
            *kept,
            label,
            F.when(F.col("pos") == 0, 0.0).otherwise((F.col(time) - F.col("prev_time")).cast("double")).alias("delta_t"),
        )
    )


def delta_time(log: DataFrame, line: str = "line_id", time: str = "ts_sec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Seconds since the previous line; the first line has 0."""
    scanned = scan_log(log, line, time, block_rows)
    return scanned.withColumn("delta_t", F.coalesce((F.col(time) - F.col("prev_time")).cast("double"), F.lit(0.0)))


def tumbling_time_windows(log: DataFrame, size: int, time: str = "ts_sec", label: str = "label") -> DataFrame:
    """Calendar-aligned bins ``bin_start, n_events, label``; bins without lines are present with NULL label."""
    binned = (
        log.groupBy((F.floor(F.col(time) / size) * size).alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(label).alias("label"))
    )
    lo, hi = log.agg(F.min(time), F.max(time)).first()
    first, last = lo // size * size, hi // size * size
    grid = log.sparkSession.range(first, last + 1, size).withColumnRenamed("id", "bin_start")
    return grid.join(binned, "bin_start", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def tumbling_time_window_events(log: DataFrame, size: int, line: str = "line_id", time: str = "ts_sec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    binned = log.withColumn("bin_start", F.floor(F.col(time) / size) * size)
    return dense_position(binned, [line], ["bin_start"], "pos", "n_events", None, block_rows)


def window_event_counts(
    log: DataFrame,
    window: int,
    step: int,
    line: str = "line_id",
    time: str = "ts_sec",
    label: str = "label",
    event: str = "event",
    strict_reference: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Event-count windows that keep empty and repeated windows: ``(k, label)`` and ``(k, event, n)``.

    ``strict_reference`` moves the window end from the last event time of the first window, and the
    window start never passes the end of the window before; otherwise both ends follow the plain rule.
    """
    t0, t1 = _bounds(log, line, time)
    offset = F.col("m") - t0
    if strict_reference:
        beyond = log.where(F.col(time) >= t0 + window).agg(F.min(line)).first()[0]
        if beyond is None:
            first_end, last = t1, -1
        else:
            first_end = log.where(F.col(line) < beyond).agg(F.max_by(time, line)).first()[0]
            last = (t1 - first_end) // step + 1
        late = F.when(offset >= window, F.floor((F.col("m") - first_end) / step) + 1).otherwise(0)
        lowest, highest = late, F.greatest(F.floor(offset / step), late)
    else:
        last = max(0, (t1 - t0 - window) // step + 1)
        lowest = F.greatest(F.lit(0), F.floor((offset - window) / step) + 1)
        highest = F.floor(offset / step)
    cells = (
        scan_log(log, line, time, block_rows)
        .groupBy(F.col("time_so_far").alias("m"), event)
        .agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("label"))
    )
    spread = (
        cells.withColumn("_hi", F.least(F.lit(last), highest).cast("bigint"))
        .withColumn("_lo", lowest.cast("bigint"))
        .withColumn("k", F.explode(F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi"))))
    )
    counts = spread.groupBy("k", event).agg(F.sum("n").alias("n"), F.max("label").alias("label"))
    labels = counts.groupBy("k").agg(F.max("label").alias("label"))
    windows = (
        log.sparkSession.range(last + 1)
        .withColumnRenamed("id", "k")
        .join(labels, "k", "left")
        .withColumn("label", F.coalesce("label", F.lit(0)))
    )
    return windows, counts.drop("label")


def next_event_windows(events: DataFrame, width: int, event: str = "event", pad: str = PAD_EVENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every ``width`` consecutive events with the event that follows.

    One row per window start: ``ctx`` (array), ``next_event``. The last window of a session has the
    pad as its target; a session shorter than the width gives one padded window.
    """
    ahead = {f"_e{i}": (event, i) for i in range(1, width + 1)}
    near = with_neighbours(events, ["session_id"], "pos", ahead, block_rows)
    filled = [F.col(event)] + [F.coalesce(F.col(f"_e{i}"), F.lit(pad)) for i in range(1, width + 1)]
    return (
        near.where(F.col("pos") <= F.greatest(F.lit(0), F.col("n_events") - width))
        .withColumn("ctx", F.array(*filled[:width]))
        .withColumn("next_event", filled[width])
        .drop(*ahead)
    )


def next_event_features(encoded: DataFrame, width: int, idx: str = "idx", param: str | None = None, pad: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Windows over encoded sessions with the count vector (sparse) and parameter slice of each."""
    ahead = {f"_e{i}": (idx, i) for i in range(1, width + 1)}
    if param:
        ahead |= {f"_p{i}": (param, i) for i in range(1, width)}
    near = with_neighbours(encoded, ["session_id"], "pos", ahead, block_rows)
    ids = [F.col(idx)] + [F.coalesce(F.col(f"_e{i}"), F.lit(pad).cast("bigint")) for i in range(1, width + 1)]
    out = near.where(F.col("pos") <= F.greatest(F.lit(0), F.col("n_events") - width)).withColumn("sequential", F.array(*ids[:width]))
    out = out.withColumn("quantitative", count_by_item(F.col("sequential"))).withColumn("next_idx", ids[width])
    if param:
        values = [F.col(param)] + [F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i in range(1, width)]
        out = out.withColumn("parameters", F.array(*values))
    return out.drop(*ahead)


def session_features(encoded: DataFrame, length: int = 50, classes: int | None = None, idx: str = "idx") -> DataFrame:
    """Fixed-length ids and dense count vector per session; only the first ``length`` events travel.

    The vector counts ids 0 to ``classes - 1``; by default there are as many as the data need. An id beyond them is an error.
    """
    if classes is None:
        classes = (encoded.agg(F.max(idx)).first()[0] or 0) + 1
    beyond = F.raise_error(F.concat(F.lit(f"event id beyond the {classes} classes: "), F.col(idx).cast("string")))
    encoded = encoded.withColumn(idx, F.when(F.col(idx) < classes, F.col(idx)).otherwise(beyond.cast("bigint")))
    head = encoded.where(F.col("pos") < length)
    return (
        head.groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col(idx).alias("idx")))).alias("_rows"), F.max("label").alias("label"))
        .withColumn("_ids", F.transform("_rows", lambda r: r["idx"]))
        .withColumn("sequential", F.slice(F.concat("_ids", F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length))
        .withColumn(
            "quantitative",
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.lit(classes - 1).cast("bigint")),
                lambda c: F.size(F.filter("sequential", lambda x: x == c)),
            ),
        )
        .drop("_rows", "_ids")
    )


def session_semantics(features: DataFrame, vectors: DataFrame, dim: int, key: str = "event_idx", vector: str = "vector") -> DataFrame:
    """Vector per position of the fixed-length ids; id 0 (padding) has a vector of -1."""
    at = features.select("session_id", F.posexplode("sequential").alias("pos", "idx"))
    joined = lookup(at, vectors.select((F.col(key) + 1).alias("idx"), F.col(vector).alias("semantic")), ["idx"])
    blank = F.array_repeat(F.lit(-1.0), dim)
    return joined.withColumn("semantic", F.when(F.col("idx") == 0, blank).otherwise(F.col("semantic").cast("array<double>")))


def chunk_sequence(
    events: DataFrame, window_size: int = 20, adaptive: bool = False, seq_len: int | None = None, min_len: int = 0
) -> DataFrame:
    """Drop short sessions, cut at ``seq_len``, number consecutive chunks; rows keep events and lines in step."""
    kept = events.where(F.col("n_events") >= min_len)
    if seq_len is not None:
        kept = kept.where(F.col("pos") < seq_len)
    if adaptive:
        return kept.withColumn("chunk", F.lit(0).cast("bigint")).withColumn("chunk_pos", F.col("pos"))
    return kept.withColumn("chunk", F.floor(F.col("pos") / window_size)).withColumn("chunk_pos", F.col("pos") % window_size)


def pad_sequences(
    encoded: DataFrame, batch: str, seq_len: int | None = None, percentile: int | None = None, dynamic: bool = True, pad: int = 0
) -> DataFrame:
    """Pad every session to its batch's length: the longest, a percentile of lengths, or ``seq_len``.

    Padding rows are added in long form; events beyond the batch length are cut.
    """
    heads = encoded.where(F.col("pos") == 0)
    if dynamic:
        at = F.max("n_events") if percentile in (None, 100) else F.percentile("n_events", percentile / 100)
        width = F.floor(at).cast("bigint")
        width = width if seq_len is None else F.least(width, F.lit(seq_len).cast("bigint"))
        widths = heads.groupBy(batch).agg(width.alias("width"))
    else:
        widths = heads.select(batch).distinct().withColumn("width", F.lit(seq_len).cast("bigint"))
    widths = materialise(widths)
    sized = lookup(heads, widths, [batch], "inner").select("session_id", batch, "n_events", "width")
    pads = sized.where(F.col("width") > F.col("n_events")).select(
        "session_id", batch, F.explode(F.sequence("n_events", F.col("width") - 1)).alias("pos"), F.lit(pad).cast("bigint").alias("idx"), "width"
    )
    body = lookup(encoded, widths, [batch], "inner").where(F.col("pos") < F.col("width")).select("session_id", batch, "pos", "idx", "width")
    return body.unionByName(pads)
