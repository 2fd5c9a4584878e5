"""Raw lines to structured logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweir.functions import text as T
from logweir.operators.ordering import BLOCK_ROWS, dense_position


def line_index(lines: DataFrame, order: str = "line_no", out: str = "line_idx", start: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dense index in file order."""
    numbered = dense_position(lines, [order], (), out, None, None, block_rows)
    return numbered.withColumn(out, F.col(out) + start) if start else numbered


def match_log_format(lines: DataFrame, log_format: str, line: str = "line") -> DataFrame:
    """One string column per format field; lines that do not match as a whole are dropped.

    The match is a generator of no or one row, so the pattern runs once per line: a filter on the
    match would be pushed below the projection and run the pattern again.
    """
    fields = T.format_fields(log_format)
    found = T.match_groups(T.strip(F.col(line)), T.format_pattern(log_format), len(fields))
    kept = [c for c in lines.columns if c != line]
    matched = lines.select(*kept, F.explode(F.filter(F.array(found), lambda f: f.isNotNull())).alias("_f"))
    return matched.select(*kept, *[F.get("_f", F.lit(i)).alias(name) for i, name in enumerate(fields)])


def parse_log_format(lines: DataFrame, log_format: str, line: str = "line", order: str = "line_no", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Structured log with ``line_id`` 1..n over the matched lines only."""
    return line_index(match_log_format(lines, log_format, line), order, "line_id", 1, block_rows)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all cores by ``keys`` when the scan has fewer tasks than that (a few small files).

    A scan with enough tasks is left alone, so large inputs pay no extra shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def text_messages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of multi-line texts, empty lines kept: ``key, line_pos, msg``."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_pos", "msg"))


def param_arity_check(lines: DataFrame, template: str = "template", params: str = "params") -> DataFrame:
    """Rows whose parameter count differs from the placeholders of their template."""
    return lines.where(F.size(params) != T.placeholder_count(F.col(template)))


def templates_per_id(dictionary: DataFrame, event: str = "event_id", template: str = "event_template") -> DataFrame:
    """Ids that stand for more than one template."""
    return dictionary.groupBy(event).agg(F.countDistinct(template).alias("templates")).where(F.col("templates") > 1)
