"""Incremental ingest of a landing directory with Structured Streaming.

Each micro-batch is normalized (P4), gated (F1), labeled with user labels preferred
(L9), and merged into the calls snapshot with keep-last per (call_id, start_time)
(W1); a later batch wins. The merge reads and writes only the months that the batch
has calls of and publishes a new snapshot version, whose manifest names the last batch, so a
restarted query (same checkpoint) re-runs an unfinished batch without exposing partial
output and skips one that was published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters as flt
from ..operators import labels as lab
from ..operators.normalize import normalize_calls
from ..schema import CALL_COLUMNS, CALLS
from ..sources import io


#: order of rows with one key inside a trigger: upload time, file, row
SEQUENCE = ("_time", "_file", "_row")


def merge_batch(batch: DataFrame, batch_id: int, snapshot_root: str, rejects_root: str,
                rules: lab.RuleSet = lab.DEFAULT_RULES, source: str = "") -> None:
    """Merge one micro-batch of a source. A replayed batch gives the same snapshot, and its rejects replace
    those of its first run (they are kept by batch, every rejected row)."""
    order = [c for c in SEQUENCE if c in batch.columns]
    if "_row" in order:
        batch = batch.withColumn("_row", F.monotonically_increasing_id())
    norm = normalize_calls(batch, keep=order)
    included, excluded = flt.gate(norm)
    io.merge_calls_snapshot(lab.relabel(included, rules), snapshot_root, order, source=source, batch=int(batch_id))
    excluded.write.mode("overwrite").parquet(f"{rejects_root}/batch={int(batch_id)}")


def start_ingest(spark: SparkSession, landing: str, snapshot_root: str, rejects_root: str,
                 checkpoint: str, *, fmt: str = "parquet", columns=CALL_COLUMNS, rules: lab.RuleSet = lab.DEFAULT_RULES,
                 available_now: bool = True):
    """Start the streaming ingest; returns the StreamingQuery. CSV landings have one layout, ``columns``."""
    if fmt == "csv":
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        src = spark.readStream.options(**io.CSV_OPTIONS).option("enforceSchema", "false").schema(schema).csv(landing)
    else:
        src = spark.readStream.schema(CALLS).parquet(landing)
    src = src.select("*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_name").alias("_file"),
                     F.lit(0).cast("long").alias("_row"))
    w = (src.writeStream.foreachBatch(lambda df, bid: merge_batch(df, bid, snapshot_root, rejects_root, rules, checkpoint))
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
