"""Tables written between the steps of an operator, in the cluster's shared folder.

A written table cuts lineage: later steps read it again after a lost executor, and
nothing above it is computed twice. The folder is scratch; whoever runs the cluster clears it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one only where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not folder and not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
    if not current:
        spark.sparkContext.setCheckpointDir(folder)
    return (folder or current).rstrip("/")


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a frame as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
