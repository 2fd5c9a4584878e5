"""Views that give the driver tables the shape of logs, sessions, messages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.functions.text import HDFS_MASKS, epoch_seconds, mask_variables
from logweir.operators.ordering import BLOCK_ROWS
from logweir.operators.parsing import match_log_format, parse_log_format, text_messages, widen
from logweir.operators.sessions import sessionize

LOG_FORMAT = "<Label> <Epoch> <Date> <Time> <Node>: <Content>"
NUMBER_MASKS = (*HDFS_MASKS, r"\d+")
WEEK = 7 * 24 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, ts_sec, label, event, user_id`` with time non-decreasing by line."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"),
        epoch_seconds(F.col("ts")).alias("ts_sec"),
        (F.col("value") > 200).cast("int").alias("label"),
        F.concat("event_type", F.floor(_k() / 25).cast("string")).alias("event"),
        "user_id",
    )


def unsorted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("line_id") % 13 == 12, 7200).otherwise(0)
    return timed_events(spark, sf_dir).withColumn("ts_sec", F.col("ts_sec") - late)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, line``: raw log text built from the events."""
    e = widen(table(spark, sf_dir, "events"), "event_id").withColumn("k", _k())
    k, u, i = F.col("k").cast("string"), F.col("user_id").cast("string"), F.col("event_id")
    ki = F.col("k")
    stamp = F.col("ts").cast("string")
    content = (
        F.when(
            F.col("event_type") == "click",
            F.concat(
                F.lit("Receiving block blk_"), u, F.lit(" src: /10.0.0."), k, F.lit(":"), (5000 + i % 1000).cast("string"),
                F.lit(" dest: /10.0.1."), k, F.lit(":50010"),
            ),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit("Served block blk_"), u, F.lit(" to /10.0.0."), k))
        .when(
            F.col("event_type") == "signup",
            F.concat(
                F.lit("BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.0.0."), k, F.lit(":50010 is added to blk_"), u,
                F.lit(" size "), (100 * ki).cast("string"),
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("PacketResponder "), (ki % 3).cast("string"), F.lit(" for block blk_"), u, F.lit(" terminating")),
        )
        .otherwise(
            F.concat(
                F.lit("Exception in receiveBlock for block blk_"), u, F.lit(" java.io.IOException: Connection reset by peer /data/dir"),
                (ki % 5).cast("string"), F.lit("/f"), k,
            )
        )
    )
    more = F.concat(
        content,
        F.when(i % 50 == 0, F.concat(F.lit(" mirror blk_"), (F.col("user_id") + 1).cast("string"))).otherwise(""),
        F.when(i % 60 == 0, F.concat(F.lit(" retry blk_"), u)).otherwise(""),
    )
    line = F.when(i % 97 == 0, F.concat(F.lit("corrupt line "), i.cast("string"))).otherwise(
        F.concat(
            F.when(F.col("value") > 200, "ERR").otherwise("-"), F.lit(" "), epoch_seconds(F.col("ts")).cast("string"), F.lit(" "),
            F.translate(F.substring(stamp, 1, 10), "-", "."), F.lit(" "), F.substring(stamp, 12, 8), F.lit(" node"),
            (ki % 8).cast("string"), F.lit(": "), more,
        )
    )
    return e.select(i.alias("line_no"), line.alias("line"))


def structured_log(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``line_no, line_id, Label, Epoch, Date, Time, Node, Content``."""
    return parse_log_format(raw_lines(spark, sf_dir), LOG_FORMAT, block_rows=block_rows)


def matched_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured log keyed by ``line_no`` only, where no dense id is needed."""
    return match_log_format(raw_lines(spark, sf_dir), LOG_FORMAT)


def masked_log(spark: SparkSession, sf_dir: str, patterns=NUMBER_MASKS) -> DataFrame:
    return matched_log(spark, sf_dir).withColumn("template", mask_variables(F.col("Content"), patterns))


def sessions(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``session_id, pos, line_id, event, ts_sec, label, n_events, first_line``; a session is a user's week."""
    e = timed_events(spark, sf_dir)
    start = e.agg(F.min("ts_sec")).first()[0]
    keyed = e.withColumn("session_id", F.concat_ws("_", "user_id", F.floor((F.col("ts_sec") - start) / WEEK).cast("string")))
    keyed = keyed.withColumnRenamed("label", "line_label").drop("user_id")
    return sessionize(keyed, totals={"label": ("max", "line_label")}, block_rows=block_rows).drop("line_label")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_pos, msg``."""
    return widen(text_messages(table(spark, sf_dir, "documents")), "doc_id", "line_pos")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
