"""Spark session helpers.

The library never creates hidden sessions; these helpers exist for tests, the
bench and command-line jobs. On a cluster the session comes from the caller and
``spark.checkpoint.dir`` is expected to name a shared folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_TZ_DEFAULT = "Europe/Berlin"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "callsight") -> SparkSession:
    """Local session with AQE on and UTC session time (tests / bench)."""
    master = master or os.environ.get("CALLSIGHT_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("CALLSIGHT_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CALLSIGHT_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", os.environ.get("CALLSIGHT_ANSI", "false"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every query relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: that of ``spark.checkpoint.dir``, or the one the context already has.

    Only a local session without either (tests) gets a fresh folder of its own; a cluster
    must name one that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not folder and not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="callsight-ckpt-")
    if not current:
        spark.sparkContext.setCheckpointDir(folder)
    return folder or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint directory for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A frame written once to the shared scratch folder and read from there: it is computed once, and a
    lost executor reads it again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
