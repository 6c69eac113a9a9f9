"""Canonical ``calls`` schema and label vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's vocabularies and column order) ---
CONNECTION_LABELS = ["Connected", "Disconnected"]
TYPE_LABELS = ["Inquiry", "Billing/Sales", "Support", "Complaint", "Unknown"]
OUTCOME_LABELS = ["Resolved", "Callback", "Refund", "Sale-close", "Unknown"]
CONNECTION_ORDER = ["Connected", "Disconnected", "Unknown"]
CALL_COLUMNS = [
    "call_id", "start_time", "duration_seconds", "transcript", "agent_id", "campaign",
    "customer_name", "product_name", "quantity", "amount", "order_id",
    "Connected", "Type", "Outcome",
]
EXCLUDED_REASON_GATE = "short/non-English"
# --- end fixed values ---

UNKNOWN = "Unknown"

CALLS = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("campaign", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("Connected", T.StringType()),
    T.StructField("Type", T.StringType()),
    T.StructField("Outcome", T.StringType()),
])

EXCLUDED = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("reason", T.StringType()),
])

# Transcript payload (one JSON document per processed recording).
PAYLOAD = T.StructType([
    T.StructField("transcript", T.StringType()),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]))),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("compute", T.StringType()),
    T.StructField("source", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("size", T.LongType()),
    ])),
])

INDEX_DOCS = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
