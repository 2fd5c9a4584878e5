"""Readers for raw logs, structured logs, label tables and sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from logweir.functions.text import strip
from logweir.operators.ordering import lookup
from logweir.session import materialise

# A split's row is about 200 bytes and a split usually 128 MB, so this many describe some 250 TB.
SPLIT_ROWS = 2_000_000


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (0-based, file order) and ``line``.

    Files are ordered by path. Inside a scan task the running id grows with file position, so every
    file split needs only its first id and row count to be placed: one small row per split. The lines
    themselves are not shuffled. Should the scan be cut differently the second time, some row's id lies
    outside its split's range and the job fails instead of numbering wrongly.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = materialise(raw.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_at", "_first", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = lookup(raw, starts, ["_file", "_at"], small=SPLIT_ROWS, rows=splits.count())
    offset = F.col("_id") - F.col("_first")
    sound = (offset >= 0) & (offset < F.col("_rows"))
    number = F.when(sound, F.col("_start") + offset).otherwise(
        F.raise_error(F.lit("file splits changed between two passes; fix spark.sql.files.minPartitionNum"))
    )
    return placed.select(number.cast("bigint").alias("line_no"), "line")


def read_structured_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A structured log with every field as text; empty fields stay empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frame = (
        spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').csv(path)
    )
    return frame.na.fill("")


def read_label_table(spark: SparkSession, path: str, key: str = "BlockId", label: str = "Label", anomaly: str = "Anomaly") -> DataFrame:
    """``session_id, label`` with 1 for the anomaly word."""
    frame = spark.read.schema(f"{key} string, {label} string").option("header", True).csv(path)
    return frame.select(F.col(key).alias("session_id"), (F.col(label) == anomaly).cast("int").alias("label"))


def parse_sequences(lines: DataFrame, line: str = "line", key: str = "line_no") -> DataFrame:
    """Text lines of ``token[,dt]`` to ``session_id, pos, event, dt, n_events``; the first dt is 0, a missing one too."""
    tokens = F.filter(F.split(strip(F.col(line)), r"\s+"), lambda t: t != "")
    exploded = lines.withColumn("_tokens", tokens).select(
        F.col(key).alias("session_id"), F.size("_tokens").cast("bigint").alias("n_events"), F.posexplode("_tokens").alias("pos", "_token")
    )
    parts = F.split("_token", ",")
    dt = F.when((F.col("pos") > 0) & (F.size(parts) == 2), F.try_element_at(parts, F.lit(2)).cast("double")).otherwise(0.0)
    return exploded.select("session_id", F.col("pos").cast("bigint").alias("pos"), F.element_at(parts, 1).alias("event"), dt.alias("dt"), "n_events")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return parse_sequences(read_log_lines(spark, path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
