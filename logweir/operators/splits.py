"""Deterministic splits and samples. Random order is the order of ``md5(seed:id)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.operators.ordering import BLOCK_ROWS, dense_position, hash_rank, hash_sample

TRAIN, TEST, TEST_NORMAL, TEST_ABNORMAL = "train", "test", "test_normal", "test_abnormal"


def _share(n: Column, ratio: float) -> Column:
    """A ratio below 1 is a share (rounded down); from 1 on it is a row count."""
    return F.lit(int(ratio)) if ratio >= 1 else F.floor(n * F.lit(float(ratio)))


def take_prefix(df: DataFrame, n: int | None = None, ratio: float | None = None, idx: str = "line_idx", size: str | None = None) -> DataFrame:
    """The first rows by dense index: a count, or a share of ``size`` (a column holding the row count)."""
    if n is not None:
        return df.where(F.col(idx) < n)
    return df.where(F.col(idx) < F.floor(F.col(size) * F.lit(float(ratio))))


def seeded_shuffle(df: DataFrame, ids: list[str], seed: int, by: list[str] | None = None, size: str | None = None) -> DataFrame:
    return hash_rank(df, ids, seed, by or (), "shuffle_rank", size)


def split_normal_abnormal(sessions: DataFrame, ratio: float, seed: int, label: str = "label", key: str = "session_id") -> DataFrame:
    """Shuffled normals: the first part trains, the rest is ``test_normal``; all abnormal are ``test_abnormal``."""
    ranked = hash_rank(sessions.where(F.col(label).isNotNull()), [key], seed, [label], "_rank", "_size")
    split = (
        F.when(F.col(label) == 1, TEST_ABNORMAL)
        .when(F.col("_rank") < _share(F.col("_size"), ratio), TRAIN)
        .otherwise(TEST_NORMAL)
    )
    return ranked.withColumn("split", split).drop("_rank", "_size")


def split_stratified(sessions: DataFrame, ratio: float, order: tuple[str, ...] = ("first_line", "session_id"), label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same share of each class, in order."""
    ranked = dense_position(sessions, order, [label], "_rank", "_size", None, block_rows)
    split = F.when(F.col("_rank") < F.floor(F.col("_size") * F.lit(float(ratio))), TRAIN).otherwise(TEST)
    return ranked.withColumn("split", split).drop("_rank", "_size")


def split_sequential(sessions: DataFrame, ratio: float, order: tuple[str, ...] = ("first_line", "session_id"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    ranked = dense_position(sessions, order, (), "_rank", "_size", None, block_rows)
    split = F.when(F.col("_rank") < F.floor(F.col("_size") * F.lit(float(ratio))), TRAIN).otherwise(TEST)
    return ranked.withColumn("split", split).drop("_rank", "_size")


def split_holdout(df: DataFrame, ids: list[str], valid_share: float, seed: int) -> DataFrame:
    """A random validation share of rows."""
    ranked = hash_rank(df, ids, seed, (), "_rank", "_size")
    split = F.when(F.col("_rank") < F.floor(F.col("_size") * F.lit(float(valid_share))), "valid").otherwise(TRAIN)
    return ranked.withColumn("split", split).drop("_rank", "_size")


def mix_abnormal_into_train(sessions: DataFrame, seed: int, split: str = "split", key: str = "session_id") -> DataFrame:
    """Move ``min(n_train / 2, 0.4 n_abnormal)`` shuffled abnormal sessions to the training side."""
    ranked = hash_rank(sessions, [key], seed, [split], "_rank")
    sizes = {r[split]: r["count"] for r in sessions.groupBy(split).count().collect()}
    moved = min(sizes.get(TRAIN, 0) // 2, int(sizes.get(TEST_ABNORMAL, 0) * 0.4))
    side = F.when(F.col(split) == TRAIN, TRAIN).when((F.col(split) == TEST_ABNORMAL) & (F.col("_rank") < moved), TRAIN).otherwise(TEST)
    return ranked.withColumn("side", side).withColumn("y", (F.col(split) == TEST_ABNORMAL).cast("int")).drop("_rank")


def sample_without_replacement(df: DataFrame, ids: list[str], ratio: float | int, seed: int) -> DataFrame:
    """Exactly ``int(n * ratio)`` random rows; an integer is the number of rows."""
    wanted = F.lit(ratio) if isinstance(ratio, int) else F.floor(F.col("_total") * F.lit(float(ratio)))
    return hash_sample(df, ids, wanted, seed, "_rank").drop("_rank")


def sort_by_length(sessions: DataFrame, size: str = "n_events", key: str = "session_id") -> DataFrame:
    return sessions.orderBy(F.desc(size), F.asc(key))
