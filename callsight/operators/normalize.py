"""Schema operators: canonical columns, lenient casts, label normalization, projections."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..schema import CALL_COLUMNS, CALLS, CONNECTION_LABELS, OUTCOME_LABELS, TYPE_LABELS, UNKNOWN

_TYPES = {f.name: f.dataType for f in CALLS.fields}


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add missing canonical columns as typed nulls, project to canonical order."""
    cols = []
    for c in CALL_COLUMNS:
        cols.append(F.col(c) if c in df.columns else F.lit(None).cast(_TYPES[c]).alias(c))
    return df.select(*cols)


def _lenient(c: str, dtype: T.DataType, src: T.DataType) -> Column:
    col = F.col(c)
    if isinstance(dtype, T.TimestampType):
        if isinstance(src, (T.TimestampType,)):
            return col
        return col.try_cast("timestamp")
    if isinstance(dtype, T.LongType):
        d = col.try_cast("double")
        return F.when(~F.isnan(d) & (d == F.floor(d)), d.cast("bigint"))
    if isinstance(dtype, T.DoubleType):
        d = col.try_cast("double")
        return F.when(~F.isnan(d), d)           # NaN -> null (D1)
    return col.cast("string")


def coerce_types(df: DataFrame) -> DataFrame:
    """Lenient casts; bad timestamps / numbers become null."""
    out = ensure_columns(df)
    src = {f.name: f.dataType for f in out.schema.fields}
    return out.select(*[_lenient(c, _TYPES[c], src[c]).alias(c) for c in CALL_COLUMNS])


def normalize_labels(df: DataFrame) -> DataFrame:
    """Out-of-set Type/Outcome -> 'Unknown' (null too); out-of-set Connected -> null."""
    out = df
    if "Type" in df.columns:
        out = out.withColumn("Type", F.when(F.col("Type").isin(TYPE_LABELS), F.col("Type"))
                             .otherwise(F.lit(UNKNOWN)))
    if "Outcome" in df.columns:
        out = out.withColumn("Outcome", F.when(F.col("Outcome").isin(OUTCOME_LABELS), F.col("Outcome"))
                             .otherwise(F.lit(UNKNOWN)))
    if "Connected" in df.columns:
        out = out.withColumn("Connected", F.when(F.col("Connected").isin(CONNECTION_LABELS),
                                                 F.col("Connected")))
    return out


def normalize_calls(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P1 -> P2 -> P3, canonical order; ``keep`` names further columns to carry along as they are."""
    if not keep:
        return df.transform(ensure_columns).transform(coerce_types).transform(normalize_labels)
    src = {f.name: f.dataType for f in df.schema.fields}
    casts = [(_lenient(c, _TYPES[c], src[c]) if c in src else F.lit(None).cast(_TYPES[c])).alias(c) for c in CALL_COLUMNS]
    return normalize_labels(df.select(*casts, *keep))


def empty_calls(spark: SparkSession) -> DataFrame:
    """P5."""
    return spark.createDataFrame([], CALLS)


def dq_report(df: DataFrame) -> DataFrame:
    """Data-quality warnings as rows (one aggregate pass + schema diff)."""
    spark = df.sparkSession
    missing = [c for c in CALL_COLUMNS if c not in df.columns]
    rows = []
    if missing:
        rows.append(spark.createDataFrame([(f"Missing columns added as empty: {', '.join(missing)}",)],
                                          "warning string"))
    checks = []
    if "duration_seconds" in df.columns:
        checks.append(F.when(F.max(F.col("duration_seconds").try_cast("double") < 0),
                             F.lit("Some rows have negative duration_seconds (will be treated as 0).")))
    if "start_time" in df.columns:
        ts = F.col("start_time")
        if not isinstance(df.schema["start_time"].dataType, (T.TimestampType, T.TimestampNTZType)):
            ts = ts.try_cast("timestamp")
        checks.append(F.when(F.count(ts) == 0,
                             F.lit("start_time could not be parsed for any rows (check your timestamps).")))
    if checks:
        agg = df.agg(F.array_compact(F.array(*checks)).alias("w")).select(F.explode("w").alias("warning"))
        rows.append(agg)
    notes = [n for n, c in (("customer", "customer_name"), ("product", "product_name")) if c not in df.columns]
    if notes:
        rows.append(spark.createDataFrame(
            [(f"Note: {', '.join(notes)} columns are not available in the dataset.",)], "warning string"))
    if not rows:
        return spark.createDataFrame([], "warning string")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- fixed values: projection column lists ---
PREVIEW_COLUMNS = ["call_id", "start_time", "agent_id", "campaign", "customer_name", "product_name",
                   "quantity", "amount", "Connected", "Type", "Outcome"]
TABLE_COLUMNS = ["call_id", "start_time", "agent_id", "campaign", "Connected", "Type", "Outcome",
                 "duration_seconds"]
# --- end fixed values ---


def preview_table(df: DataFrame, *, show_pii: bool = False, cap: int = 50,
                  order: Sequence[Column] | None = None) -> DataFrame:
    """Preview projection, masked customer names, capped with an explicit order."""
    cols = [c for c in PREVIEW_COLUMNS if c in df.columns]
    out = df.select(*cols)
    if "customer_name" in cols and not show_pii:
        out = out.withColumn("customer_name", tx.mask_name(F.col("customer_name")))
    order = order if order is not None else [F.col("call_id")]
    return out.orderBy(*order).limit(int(cap))


def calls_table(df: DataFrame) -> DataFrame:
    """Calls-table projection (columns present only)."""
    return df.select(*[c for c in TABLE_COLUMNS if c in df.columns])


def call_summary(df: DataFrame, *, pii_mask: bool = True) -> Column:
    """P12: 'Call <id> • <time> • C/T/O[ • name]'."""
    cust = F.col("customer_name")
    if pii_mask:
        cust = tx.mask_name(cust)
    base = F.concat_ws("", F.lit("Call "), F.coalesce(F.col("call_id"), F.lit("None")), F.lit(" • "),
                       F.coalesce(F.date_format("start_time", "yyyy-MM-dd HH:mm:ssxxx"), F.lit("NaT")),
                       F.lit(" • "),
                       F.coalesce(F.col("Connected"), F.lit("None")), F.lit("/"),
                       F.coalesce(F.col("Type"), F.lit("None")), F.lit("/"),
                       F.coalesce(F.col("Outcome"), F.lit("None")))
    return F.when((cust.isNotNull()) & (cust != ""), F.concat(base, F.lit(" • "), cust)).otherwise(base)
