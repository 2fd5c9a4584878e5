"""Sinks. Tables are parquet; text and CSV forms exist for exchange with other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SEGMENT = 1 << 16


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_log_text(lines: DataFrame, path: str, order: str = "line_no", line: str = "line") -> str:
    """A raw log whose files, read in path order, give the lines in order."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(line).write.mode("overwrite").text(path)
    return path


def write_structured(lines: DataFrame, templates: DataFrame, folder: str) -> tuple[str, str]:
    """Structured log and template dictionary."""
    return write_table(lines, f"{folder}/structured"), write_table(templates, f"{folder}/templates")


def write_structured_csv(lines: DataFrame, path: str) -> str:
    lines.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def write_label_table(labels: DataFrame, path: str) -> str:
    out = labels.select(
        F.col("session_id").alias("BlockId"), F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("Label")
    )
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def sequence_lines(events: DataFrame, columns: list[str], segment: int = SEGMENT, extra: list[str] | None = None) -> DataFrame:
    """Sessions as text lines of blank-separated tokens, a token being the columns joined by commas.

    ``session_id, part, line``: a session of up to ``segment`` events is one line; a longer one goes on
    in further parts, so that no row grows without bound.
    """
    token = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col("pos"), token.alias("token"))))
    return (
        events.groupBy("session_id", *(extra or []), F.floor(F.col("pos") / segment).alias("part"))
        .agg(rows.alias("_rows"))
        .select("session_id", *(extra or []), "part", F.array_join(F.transform("_rows", lambda r: r["token"]), " ").alias("line"))
    )


def write_sequences(events: DataFrame, columns: list[str], path: str, segment: int = SEGMENT) -> str:
    return write_table(sequence_lines(events, columns, segment), path)


def write_sequence_text(events: DataFrame, columns: list[str], path: str, order: list[str], segment: int = SEGMENT) -> str:
    """One text line per session, in ``order``; refuses sessions that need several parts."""
    if not events.where(F.col("pos") >= segment).isEmpty():
        raise ValueError("a session is longer than one text line may be; use write_sequences")
    lines = sequence_lines(events, columns, segment, order)
    keys = [*order, "session_id"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)
    return path


def write_session_tables(events: DataFrame, folder: str, event: str = "event", line: str = "line_id") -> tuple[str, str]:
    """Event sequences and line-index sequences per session, in step."""
    return (
        write_table(events.select("session_id", "pos", event), f"{folder}/event_sequence"),
        write_table(events.select("session_id", "pos", line), f"{folder}/log_sequence"),
    )


def write_content_corpus(lines: DataFrame, path: str, idx: str = "line_idx", content: str = "Content") -> str:
    return write_table(lines.select(F.col(idx).alias("line_idx"), F.col(content).alias("content")), path)


def write_model_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One parquet table per fitted artifact."""
    return {name: write_table(df, f"{folder}/{name}") for name, df in tables.items()}


def write_results(results: DataFrame, path: str) -> str:
    return write_table(results, path)
