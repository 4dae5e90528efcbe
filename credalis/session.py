"""A local session for tests and benches; on a cluster the given session is used."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """Session on ``local[cores]`` with adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("credalis")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A temporary folder serves only a one-machine session that names none, as in tests.
    """
    named = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="credalis-")
        spark.conf.set(CHECKPOINT, named)
    return named.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_folder(spark)}/credalis-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: computed once, read back with its true size."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
