"""Derived inputs built from the driver tables (same definitions as the oracle SQL).

``calls`` is derived from documents ⋈ orders ⋈ customer, the first line item of
each order and its part. All joins are on keys; orders and line items that are no calls leave
by a semi-join before the first item of each order is taken (``min`` of a struct, which
Spark sorts within tasks and combines map-side). The texts are joined last, so they are shuffled
once, however many tables are too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import RuleSet
from ..session import prepare

TEXT_TABLES = ("documents", "conversations", "pages")
#: session setting: tasks over which a caller wants the text tables dealt (unset: as the files are split)
TEXT_TASKS = "spark.callsight.textTasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A caller whose text tables come as one file may ask for more tasks by ``TEXT_TASKS``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    tasks = int(spark.conf.get(TEXT_TASKS, "0"))
    return df.repartition(tasks) if tasks and name in TEXT_TABLES else df


def _raw_label(doc_id, one: str, other: str):
    m = doc_id % 7
    return (F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit(one))
            .when(m == 2, F.lit("unknown")).when(m == 3, F.lit("")).when(m == 4, F.lit("bogus"))
            .otherwise(F.lit(other)))


def first_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line item per order: lowest (l_linenumber, l_partkey, l_suppkey, l_quantity)."""
    calls = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("l_orderkey"))
    li = table(spark, sf_dir, "lineitem").join(calls, "l_orderkey", "left_semi")     # only orders that are calls
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("f")
    return (li.groupBy("l_orderkey").agg(first)
              .select("l_orderkey", "f.l_partkey", "f.l_suppkey", "f.l_quantity"))


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other tables say of the orders that are calls, without any text."""
    calls = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").join(calls, "o_orderkey", "left_semi")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    fl = first_line_items(spark, sf_dir)
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
             .join(fl, o.o_orderkey == fl.l_orderkey, "left")
             .join(p, fl.l_partkey == p.p_partkey, "left"))


def _calls(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 columns of ``calls`` from the orders' facts and the texts; a ``priority`` among the facts stays."""
    prepare(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    j = d.join(facts, F.col("doc_id") == F.col("o_orderkey"), "inner")
    doc = F.col("doc_id")
    start = F.timestamp_seconds(
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (doc * 7919) % 86400)
    return j.select(
        doc.cast("string").alias("call_id"),
        F.when(doc % 97 == 0, F.lit(None).cast("timestamp")).otherwise(start).alias("start_time"),
        F.when(doc % 50 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("n_chars").cast("double") / F.lit(20.0)).alias("duration_seconds"),
        F.col("text").alias("transcript"),
        F.when(F.col("l_suppkey").isNull(), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("A"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0")))
         .alias("agent_id"),
        F.col("c_mktsegment").alias("campaign"),
        F.col("c_name").alias("customer_name"),
        F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        _raw_label(doc, "Connected", "Disconnected").alias("Connected"),
        _raw_label(doc, "Support", "Complaint").alias("Type"),
        _raw_label(doc, "Refund", "Resolved").alias("Outcome"),
        *[c for c in ("priority",) if c in facts.columns],
    )


def calls_with_raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical 14-column ``calls`` table with raw (user-supplied) labels."""
    return _calls(_order_facts(spark, sf_dir), spark, sf_dir)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without user labels (labels are computed by the rules)."""
    return calls_with_raw_labels(spark, sf_dir).drop("Connected", "Type", "Outcome")


# --- fixed values: how the two upload batches are cut (by order priority) ---
BATCH1_EXCLUDES = ("5-LOW",)
BATCH2_PRIORITIES = ("1-URGENT", "2-HIGH", "5-LOW")
# --- end fixed values ---


def order_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, priority) — the attribute that cuts the two upload batches."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"),
                                                  F.col("o_orderpriority").alias("priority"))


def prioritized_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with raw labels and their order's ``priority``, which joins them before the texts do; ``order_id`` first."""
    priority = order_priority(spark, sf_dir).withColumnRenamed("order_id", "_order_id")
    facts = _order_facts(spark, sf_dir)
    facts = facts.join(priority, F.col("o_orderkey").cast("string") == F.col("_order_id")).drop("_order_id")
    calls = _calls(facts, spark, sf_dir)
    return calls.select("order_id", *[c for c in calls.columns if c != "order_id"])


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping upload batches over the whole calls table: batch 1 = every call whose
    order is not low priority; batch 2 = urgent, high and low priority calls re-uploaded with
    amount + 1 (so urgent/high calls are updated and low ones are new)."""
    base = prioritized_calls(spark, sf_dir)
    b1 = base.filter(~F.col("priority").isin(*BATCH1_EXCLUDES)).withColumn("batch", F.lit(1))
    b2 = (base.filter(F.col("priority").isin(*BATCH2_PRIORITIES)).withColumn("amount", F.col("amount") + 1)
              .withColumn("batch", F.lit(2)))
    return b1.unionByName(b2).drop("priority")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as timed transcript segments: start = turn, text = turn text."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").cast("string").alias("call_id"),
                       F.col("turn").cast("double").alias("start"),
                       (F.col("turn") + 1).cast("double").alias("end"),
                       F.col("role"), F.col("text"))


# --- fixed values: test rule profile (the shipped phrases do not occur in the test prose) ---
TEST_RULES = RuleSet(
    duration_cutoff_s=30, min_tokens=40, short_disconnected_s=10,
    disconnection_cues=("license", "worthless"),
    types=(
        ("Inquiry", ("of the", "from the", "was the")),
        ("Billing/Sales", ("in the", "for the", "der")),
        ("Support", ("is the", "to the", "les")),
        ("Complaint", ("that the", "by the", "los")),
    ),
    type_tie_break=("Complaint", "Support", "Billing/Sales", "Inquiry"),
    outcomes=(
        ("Resolved", ("in the", "und")),
        ("Callback", ("to the", "la")),
        ("Refund", ("is the", "for the")),
        ("Sale-close", ("that the", "with the")),
    ),
    refund_negations=("free", "worthless"),
    outcome_window_frac=0.25,
)
WIDE_NEGATION_WORDS = ("no", "without", "of", "de", "die")
# --- end fixed values ---
