"""Registered queries: batch union, keep-last merge, increments, label reuse."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import labels as lab
from ..operators import merge as mg
from ..schema import EXCLUDED
from ..session import scratch_path, staged
from ..sources import io
from ..sources import labels as label_store_runs
from . import fixtures as fx
from .common import LABEL_RULES, LABELED_SQL, fmt_ts, labeled, r6
from .oracle_sql import CALLS_RAW_CTE, fmt_ts as sfmt, label_ctes, r6 as sr6, tokens as stokens
from .registry import register

WITH_RAW = "WITH " + CALLS_RAW_CTE + ",\n"
BATCHES_SQL = WITH_RAW + """prio AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS priority FROM orders),
batches AS (
  SELECT c.*, 1 AS batch FROM calls_raw c JOIN prio p ON p.order_id = c.order_id
  WHERE p.priority <> '5-LOW'
  UNION ALL
  SELECT * REPLACE (amount + 1 AS amount), 2 AS batch FROM (
    SELECT c.* FROM calls_raw c JOIN prio p ON p.order_id = c.order_id
    WHERE p.priority IN ('1-URGENT', '2-HIGH', '5-LOW')))
"""


@register("union_batches", covers="U1", oracle=BATCHES_SQL + f"""
SELECT call_id, batch, CASE WHEN batch = 1 THEN campaign END AS campaign, {sr6('amount')} AS amount
FROM batches""")
def union_batches(spark, sf):
    b = fx.batches(spark, sf)
    b1 = b.filter(F.col("batch") == 1)
    b2 = b.filter(F.col("batch") == 2).drop("campaign")     # second upload lacks a column
    return mg.union_all([b1, b2]).select("call_id", "batch", "campaign", r6("amount").alias("amount"))


@register("keep_last", covers="W1 D14", oracle=BATCHES_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, batch, {sr6('amount')} AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY call_id, start_time ORDER BY batch DESC) AS rn FROM batches)
WHERE rn = 1""")
def keep_last(spark, sf):
    out = mg.keep_last(fx.batches(spark, sf), ("call_id", "start_time"), ("batch",))
    return out.select("call_id", fmt_ts("start_time").alias("start_time"), "batch",
                      r6("amount").alias("amount"))


KEEP_DUPS_SQL = WITH_RAW + """dups AS (
  SELECT CASE WHEN CAST(call_id AS BIGINT) % 5 = 0 THEN NULL ELSE CAST(CAST(call_id AS BIGINT) % 40 AS VARCHAR) END AS call_id,
         CASE WHEN CAST(call_id AS BIGINT) % 3 = 0 THEN NULL ELSE date_trunc('year', start_time) END AS start_time,
         CAST(call_id AS BIGINT) % 4 AS batch, CAST(call_id AS BIGINT) AS seq, amount FROM calls_raw)
"""


@register("keep_last_in_batch", covers="W1", oracle=KEEP_DUPS_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, batch, seq, {sr6('amount')} AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY call_id, start_time ORDER BY batch DESC, seq DESC) AS rn FROM dups)
WHERE rn = 1""")
def keep_last_in_batch(spark, sf):
    """Keys repeat inside a batch and may be null: the last row of the last batch stays."""
    n = F.col("call_id").cast("bigint")
    d = fx.calls(spark, sf).select(
        F.when(n % 5 != 0, (n % 40).cast("string")).alias("call_id"),
        F.when(n % 3 != 0, F.date_trunc("year", "start_time")).alias("start_time"),
        (n % 4).alias("batch"), n.alias("seq"), "amount")
    out = mg.keep_last(d, ("call_id", "start_time"), ("batch", "seq"))
    return out.select("call_id", fmt_ts("start_time").alias("start_time"), "batch", "seq", r6("amount").alias("amount"))


@register("append_excluded", covers="U2 S5", oracle=BATCHES_SQL + f"""
SELECT call_id, 'short/non-English' AS reason FROM batches WHERE len({stokens('transcript')}) < 20
UNION ALL SELECT NULL, 'short/non-English' FROM batches WHERE batch = 1 AND len({stokens('transcript')}) < 20""")
def append_excluded(spark, sf):
    """The rejects of both uploads, and those of the first once more without their ids: every row stays."""
    b, root = fx.batches(spark, sf), scratch_path(spark, f"excluded-{uuid.uuid4().hex[:12]}")
    first, second = (flt.gate(b.filter(F.col("batch") == n))[1] for n in (1, 2))
    for rejects in (first, second, first.withColumn("call_id", F.lit(None).cast("string"))):
        io.append_excluded(rejects, root)
    return io.load_snapshot(spark, root, EXCLUDED)


MONTHLY_SQL = WITH_RAW + """prio AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS priority FROM orders),
c AS (SELECT c.*, strftime(c.start_time, '%Y-%m') AS month, p.priority = '1-URGENT' AND month(c.start_time) % 2 = 0 AS again
      FROM calls_raw c JOIN prio p ON p.order_id = c.order_id)
"""


@register("monthly_merge", covers="S5 W1 X1", oracle=MONTHLY_SQL + f"""
SELECT month, count(*) AS calls, {sr6('sum(amount + CASE WHEN again THEN 1 ELSE 0 END)')} AS amount,
       CASE WHEN bool_or(again) THEN 2 ELSE 1 END AS version FROM c GROUP BY month""")
def monthly_merge(spark, sf):
    """All calls, then corrections of the urgent ones in even months, then those again: which upload wrote each month's folder."""
    root = scratch_path(spark, f"monthly-{uuid.uuid4().hex[:12]}")
    base = fx.prioritized_calls(spark, sf)
    io.merge_calls_snapshot(base.drop("priority"), root, tz="UTC", source="uploads", batch=1)
    first = {run for run, _ in io.snapshot_parts(spark, root)}
    again = (base.filter((F.col("priority") == "1-URGENT") & (F.month("start_time") % 2 == 0)).drop("priority")
             .withColumn("amount", F.col("amount") + 1))
    for _ in range(2):
        io.merge_calls_snapshot(again, root, tz="UTC", source="uploads", batch=2)
    versions = spark.createDataFrame([(None if m == io.NO_MONTH else m, 1 if run in first else 2) for run, m in io.snapshot_parts(spark, root)],
                                     "month string, version int")
    months = io.load_snapshot(spark, root).groupBy(F.col("start_month").alias("m")).agg(F.count(F.lit(1)).alias("calls"), r6(F.sum("amount")).alias("amount"))
    return months.join(F.broadcast(versions), F.col("m").eqNullSafe(F.col("month"))).select("month", "calls", "amount", "version")


@register("incremental_new", covers="J5 U6", oracle=BATCHES_SQL + """
SELECT call_id FROM batches b2 WHERE batch = 2
  AND NOT EXISTS (SELECT 1 FROM batches b1 WHERE b1.batch = 1 AND b1.call_id = b2.call_id)""")
def incremental_new(spark, sf):
    b = fx.batches(spark, sf)
    return mg.new_only(b.filter(F.col("batch") == 2), b.filter(F.col("batch") == 1), ["call_id"]) \
        .select("call_id")


@register("label_reuse", covers="J8", oracle=LABELED_SQL + """
SELECT call_id, Connected, Type, Outcome FROM labeled""")
def label_reuse(spark, sf):
    """Label each distinct (text and rule parameters, duration) once, then give the labels back by key.

    Calls of one transcript are one skewed key of a plain join, which Spark splits."""
    inc, _ = flt.gate(fx.calls(spark, sf))
    keyed = inc.withColumn("tkey", mg.labels_key(LABEL_RULES)).withColumn(
        "dkey", F.coalesce(F.col("duration_seconds").cast("string"), F.lit("")))
    distinct = keyed.select("tkey", "dkey", "transcript", "duration_seconds").dropDuplicates(["tkey", "dkey"])
    labels = lab.apply_labels(distinct, LABEL_RULES).select("tkey", "dkey", "Connected", "Type", "Outcome")
    return keyed.select("call_id", "tkey", "dkey").join(labels, ["tkey", "dkey"], "inner").select("call_id", "Connected", "Type", "Outcome")


STORE_SQL = LABELED_SQL.rstrip() + """,
p AS (SELECT CAST(o_orderkey AS VARCHAR) AS call_id, o_orderpriority AS priority FROM orders),
k AS (SELECT l.call_id, l.Connected, l.Type, l.Outcome, sha256(coalesce(l.transcript, '')) || coalesce(CAST(l.duration_seconds AS VARCHAR), '') AS k,
             p.priority FROM labeled l JOIN p ON p.call_id = l.call_id),
one AS (SELECT DISTINCT k FROM k WHERE priority <> '5-LOW')
"""


@register("label_store", covers="J8", oracle=STORE_SQL + """
SELECT 1 AS run, call_id, Connected, Type, Outcome, TRUE AS fresh FROM k WHERE priority <> '5-LOW'
UNION ALL SELECT 2, call_id, Connected, Type, Outcome, k NOT IN (SELECT k FROM one) FROM k
UNION ALL SELECT 3, call_id, 'Disconnected', Type, Outcome, TRUE FROM k""")
def label_store(spark, sf):
    """A first upload, all calls, and all calls under a changed rule: what each run had to label."""
    root = scratch_path(spark, f"labels-{uuid.uuid4().hex[:12]}")
    inc = staged(flt.gate(fx.calls(spark, sf))[0], "label-calls")       # what all three runs read
    first = inc.join(fx.order_priority(spark, sf).filter("priority <> '5-LOW'"), "order_id", "left_semi")
    changed = replace(LABEL_RULES, duration_cutoff_s=10 ** 9)
    runs = [label_store_runs.label_calls(calls, root, rules) for calls, rules in ((first, LABEL_RULES), (inc, LABEL_RULES), (inc, changed))]
    return mg.union_all([r.select(F.lit(n).alias("run"), "call_id", "Connected", "Type", "Outcome", "fresh") for n, r in enumerate(runs, 1)])


@register("manifest_new", covers="J5", oracle="""
WITH m AS (SELECT conv_id, max(turn) AS turns, sum(length(coalesce(text, ''))) AS size FROM conversations GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS name, size FROM m WHERE NOT (turns % 3 <> 0 AND size % 5 <> 0)""")
def manifest_new(spark, sf):
    """Files whose identity is not in the manifest: two thirds were transcribed, a fifth was edited since."""
    m = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size"))
    files = m.select(F.struct(F.col("conv_id").cast("string").alias("name"), F.lit(1).alias("mtime_ns"), F.col("size").alias("size")).alias("source"),
                     F.lit("base").alias("model"), F.lit("int8").alias("compute"), "turns").withColumn("key", mg.media_key())
    edited = F.when(F.col("source.size") % 5 == 0, F.col("source.size") + 1).otherwise(F.col("source.size"))
    done = files.filter(F.col("turns") % 3 != 0).withColumn("source", F.col("source").withField("size", edited)).select(mg.media_key().alias("key"))
    return mg.new_only(files, done, ["key"]).select("source.name", "source.size")
