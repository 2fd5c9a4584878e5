"""Session construction and the shared folder used for checkpoints and model tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "logweir") -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a test session without one gets a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="logweir-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, as Parquet, and cut its lineage; later readers see one fixed copy and read the columns they need."""
    path = fresh_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a cluster on which it is not installed."""
    folder = os.path.dirname(os.path.abspath(__file__))
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="logweir-"), "logweir"), "zip", os.path.dirname(folder), os.path.basename(folder))
    spark.sparkContext.addPyFile(packed)
