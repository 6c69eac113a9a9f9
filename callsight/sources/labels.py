"""A stored table of labels, looked up and written back, so that no text is labeled twice under one set of rules.

A row's key is the text's SHA-256 and the duration that the rules read; a set of rules has its own folder, named by a
digest of every parameter in it, so a changed rule misses. Below it rows lie in ``BUCKETS`` folders by the key's first
byte: a look-up joins bucket by bucket, and reads only the buckets that its keys fall into. Runs are published by a
pointer, as snapshots are; runs that label the same text at once store it twice, with equal labels.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as lab
from ..operators import merge
from ..session import staged
from . import io

BUCKETS = 16
KEY = ("text_sha", "duration_key")
LABELS = ("Connected", "Type", "Outcome")
_STORED = "text_sha string, duration_key string, Connected string, Type string, Outcome string, bucket int"


def rules_digest(rules: lab.RuleSet) -> str:
    """Identity of a rule set: every parameter, phrases in their order."""
    return hashlib.sha256(json.dumps(asdict(rules), sort_keys=True, ensure_ascii=False).encode("utf-8")).hexdigest()[:32]


def keyed(calls: DataFrame) -> DataFrame:
    """Calls with the key of their labels and its bucket."""
    duration = F.coalesce(F.col("duration_seconds").cast("double").cast("string"), F.lit(""))
    rows = calls.withColumn("text_sha", merge.transcript_key()).withColumn("duration_key", duration)
    return rows.withColumn("bucket", (F.conv(F.substring("text_sha", 1, 2), 16, 10).cast("int") % BUCKETS).cast("int"))


def open_labels(spark: SparkSession, root: str, rules: lab.RuleSet) -> DataFrame:
    """Stored labels of a rule set, one row a key; empty before the first write."""
    base = f"{root.rstrip('/')}/{rules_digest(rules)}"
    version = io._version(spark, base)
    if version is None:
        return spark.createDataFrame([], _STORED)
    paths = sorted({run for run, _ in version["parts"]})
    rows = io.merge.union_all([spark.read.schema(_STORED).parquet(f"{base}/run-{run}") for run in paths])
    return rows.groupBy(*KEY, "bucket").agg(*[F.min(c).alias(c) for c in LABELS])


def _append(rows: DataFrame, base: str) -> None:
    spark, run = rows.sparkSession, uuid.uuid4().hex
    rows.write.mode("errorifexists").partitionBy("bucket").parquet(f"{base}/run-{run}")
    version = io._version(spark, base) or {"parts": [], "batches": {}}
    io._publish(spark, base, run, {"parts": [*version["parts"], [run, None]], "batches": {}})


def compact(spark: SparkSession, root: str, rules: lab.RuleSet) -> None:
    """Rewrite a rule set's runs as one, a row a key."""
    base = f"{root.rstrip('/')}/{rules_digest(rules)}"
    if io._version(spark, base) is not None:
        run = uuid.uuid4().hex
        open_labels(spark, root, rules).write.mode("errorifexists").partitionBy("bucket").parquet(f"{base}/run-{run}")
        io._publish(spark, base, run, {"parts": [[run, None]], "batches": {}})


def label_calls(calls: DataFrame, root: str, rules: lab.RuleSet = lab.DEFAULT_RULES) -> DataFrame:
    """Calls with Connected, Type and Outcome, and ``fresh``: whether this run labeled their text.

    Texts without stored labels are labeled once each and written back. A text that a third of the calls share is one
    row of the look-up and one skewed key of the join back, which Spark splits."""
    spark, base = calls.sparkSession, f"{root.rstrip('/')}/{rules_digest(rules)}"
    rows = keyed(calls.drop(*LABELS))
    stored = open_labels(spark, root, rules)
    texts = rows.groupBy(*KEY, "bucket").agg(F.first("transcript").alias("transcript"), F.first("duration_seconds").alias("duration_seconds"))
    unknown = texts.join(stored.select(*KEY, "bucket"), [*KEY, "bucket"], "left_anti")
    fresh = staged(lab.apply_labels(unknown, rules).select(*KEY, "bucket", *LABELS), "labels-fresh")
    if not fresh.isEmpty():
        _append(fresh.hint("rebalance", "bucket"), base)
    known = stored.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return rows.join(known, [*KEY, "bucket"]).drop(*KEY, "bucket")
