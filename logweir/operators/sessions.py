"""Sessions by key, in long form: ``session_id, pos, line_id, ..., n_events, first_line``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from logweir.functions.text import BLOCK_KEY, extract_session_keys
from logweir.operators.ordering import BLOCK_ROWS, dense_position


def sessionize(
    lines: DataFrame, key: str = "session_id", line: str = "line_id", totals: Mapping[str, tuple[str, str]] | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Position of every line within its session, with session length, first line and other totals."""
    wanted = {"first_line": ("min", line), **(totals or {})}
    return dense_position(lines, [line], [key], "pos", "n_events", wanted, block_rows)


def sessionize_by_key(
    lines: DataFrame,
    content: str = "content",
    line: str = "line_id",
    pattern: str = BLOCK_KEY,
    totals: Mapping[str, tuple[str, str]] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per (line, key named in the text): a key named twice in a line counts once, a line
    naming two keys belongs to both, a line naming none to no session."""
    keyed = lines.withColumn("session_id", F.explode(extract_session_keys(F.col(content), pattern)))
    return sessionize(keyed, "session_id", line, totals, block_rows)


def join_session_labels(sessions: DataFrame, labels: DataFrame, key: str = "session_id") -> DataFrame:
    """Left join of one-row-per-session tables; a missing label stays NULL and is in neither class."""
    return sessions.join(labels, key, "left")


def zip_parallel_sequences(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("session_id", "pos")) -> DataFrame:
    """Pair two parallel sequences by position."""
    return left.join(right, list(keys))


def gather_content(events: DataFrame, corpus: DataFrame, line: str = "line_id") -> DataFrame:
    """Text of every event's line, by line index (unique in ``corpus``)."""
    return events.join(corpus, line)


def session_heads(events: DataFrame) -> DataFrame:
    """The per-session values without a shuffle: they ride on every row, so the first row has them."""
    return events.where(F.col("pos") == 0)
