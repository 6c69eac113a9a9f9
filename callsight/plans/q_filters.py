"""Registered queries: date windows, sidebar / spec filters, search, ordering and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import normalize as nz
from . import fixtures as fx
from .common import LABELED_SQL, fmt_ts, labeled, r6
from .oracle_sql import CALLS_RAW_CTE, fmt_ts as sfmt, q, r6 as sr6
from .registry import register

TZ = "Europe/Berlin"
WITH_RAW = "WITH " + CALLS_RAW_CTE + "\n"


def _utc_sql(day: str) -> str:
    """UTC instant (naive) of local midnight of ``day``."""
    return f"timezone('UTC', timezone('{TZ}', TIMESTAMP '{day} 00:00:00'))"


def _local_day_sql(e: str) -> str:
    return f"CAST(timezone('{TZ}', timezone('UTC', {e})) AS DATE)"


# ------------------------------------------------------------------ F2 / F3
@register("day_window", covers="F2 T13", oracle=WITH_RAW + f"""
SELECT call_id, {sfmt('start_time')} AS start_time FROM calls_raw
WHERE start_time >= {_utc_sql('1996-10-20')} AND start_time < {_utc_sql('1996-10-28')}""")
def day_window(spark, sf):
    # the window ends with the 25-hour local day of the 1996 autumn clock change
    c = fx.calls(spark, sf)
    return flt.date_window(c, "1996-10-20", "1996-10-27", TZ).select(
        "call_id", fmt_ts("start_time").alias("start_time"))


@register("derived_window", covers="F3", oracle=WITH_RAW + f"""
SELECT call_id, {sfmt('start_time')} AS start_time FROM calls_raw
WHERE start_time >= timezone('UTC', timezone('{TZ}',
        CAST((SELECT min({_local_day_sql('start_time')}) FROM calls_raw) AS TIMESTAMP)))
  AND start_time < {_utc_sql('1995-07-01')}""")
def derived_window(spark, sf):
    c = fx.calls(spark, sf)
    return flt.date_window(c, None, "1995-06-30", TZ).select(
        "call_id", fmt_ts("start_time").alias("start_time"))


@register("derived_window_upper", covers="F3", oracle=WITH_RAW + f"""
SELECT call_id FROM calls_raw
WHERE start_time >= {_utc_sql('1998-01-01')}
  AND start_time < timezone('UTC', timezone('{TZ}',
        CAST((SELECT max({_local_day_sql('start_time')}) FROM calls_raw) + INTERVAL 1 DAY AS TIMESTAMP)))""")
def derived_window_upper(spark, sf):
    c = fx.calls(spark, sf)
    return flt.date_window(c, "1998-01-01", None, TZ).select("call_id")


@register("sidebar_filter", covers="F4 F5", oracle=WITH_RAW + f"""
SELECT call_id FROM calls_raw
WHERE start_time >= {_utc_sql('1995-01-01')} AND start_time < {_utc_sql('1997-01-01')}
  AND agent_id = 'A003' AND campaign = 'BUILDING'""")
def sidebar_filter(spark, sf):
    c = fx.calls(spark, sf)
    f = flt.SidebarFilters(date_from="1995-01-01", date_to="1996-12-31", agent="A003", campaign="BUILDING")
    return flt.sidebar_filter(c, f, TZ).select("call_id")


@register("sidebar_all", covers="F5 D6", oracle=WITH_RAW + f"""
SELECT call_id FROM calls_raw
WHERE start_time >= timezone('UTC', timezone('{TZ}',
        CAST((SELECT min({_local_day_sql('start_time')}) FROM calls_raw) AS TIMESTAMP)))
  AND start_time < timezone('UTC', timezone('{TZ}',
        CAST((SELECT max({_local_day_sql('start_time')}) FROM calls_raw) + INTERVAL 1 DAY AS TIMESTAMP)))""")
def sidebar_all(spark, sf):
    # '(All)' everywhere and no dates: bounds come from the data; null times drop out.
    c = fx.calls(spark, sf)
    return flt.sidebar_filter(c, flt.SidebarFilters(agent=flt.ALL, campaign=flt.ALL), TZ).select("call_id")


# ------------------------------------------------------------------ F6 spec
SPECS = {
    "spec_dates": {"date_from": "1997-01-01", "date_to": "1997-03-31"},
    "spec_types": {"type_any": [" support ", "COMPLAINT"], "outcome_any": ["callback", "Resolved"]},
    "spec_agents": {"agents": ["a003", " A007 ", "  "]},
    "spec_campaigns": {"campaigns": ["building ", "Machinery"]},
    "spec_products": {"products": ["plate", "GEAR", "   "]},
    "spec_amount": {"min_amount": 100000, "max_amount": 250000.5},
    "spec_full": {"date_from": "1995-01-01", "date_to": "1998-12-31", "type_any": ["Support", "Inquiry"],
                  "agents": ["A001", "A002", "A003", "A004", "A005"], "campaigns": ["building", "machinery"],
                  "products": ["plate", "rod", "bolt"], "min_amount": 50000},
}

_SPEC_SQL = {
    "spec_dates": f"start_time >= {_utc_sql('1997-01-01')} AND start_time < {_utc_sql('1997-04-01')}",
    "spec_types": "lower(trim(Type)) IN ('support', 'complaint') AND lower(trim(Outcome)) IN ('callback', 'resolved')",
    "spec_agents": "lower(trim(agent_id)) IN ('a003', 'a007')",
    "spec_campaigns": "lower(trim(campaign)) IN ('building', 'machinery')",
    "spec_products": "(instr(lower(product_name), 'plate') > 0 OR instr(lower(product_name), 'gear') > 0)",
    "spec_amount": "amount >= 100000 AND amount <= 250000.5",
    "spec_full": (f"start_time >= {_utc_sql('1995-01-01')} AND start_time < {_utc_sql('1999-01-01')} "
                  "AND lower(trim(Type)) IN ('support', 'inquiry') "
                  "AND lower(trim(agent_id)) IN ('a001', 'a002', 'a003', 'a004', 'a005') "
                  "AND lower(trim(campaign)) IN ('building', 'machinery') "
                  "AND (instr(lower(product_name), 'plate') > 0 OR instr(lower(product_name), 'rod') > 0 "
                  "OR instr(lower(product_name), 'bolt') > 0) AND amount >= 50000"),
}

_SPEC_COVERS = {"spec_dates": "F6a D10", "spec_types": "F6b", "spec_agents": "F6c D12",
                "spec_campaigns": "F6d", "spec_products": "F6e D12", "spec_amount": "F6f",
                "spec_full": "F6"}


def _make_spec_query(name):
    spec = SPECS[name]

    def build(spark, sf):
        return flt.apply_spec(labeled(spark, sf), spec, TZ).select("call_id")
    build.__name__ = name
    register(name, covers=_SPEC_COVERS[name],
             oracle=LABELED_SQL + f"SELECT call_id FROM labeled WHERE {_SPEC_SQL[name]}")(build)


for _n in SPECS:
    _make_spec_query(_n)


@register("hide_unknown", covers="F7", oracle=LABELED_SQL + """
SELECT call_id FROM labeled
WHERE trim(coalesce(Type, '')) <> 'Unknown' AND trim(coalesce(Outcome, '')) <> 'Unknown'""")
def hide_unknown(spark, sf):
    return flt.hide_unknown(labeled(spark, sf)).select("call_id")


SEARCH_COLS = ["call_id", "agent_id", "campaign", "product_name", "Type"]


@register("search_rows", covers="F8 T11", oracle=LABELED_SQL + """
SELECT call_id FROM labeled
WHERE instr(lower(coalesce(call_id, '')), 'plate') > 0 OR instr(lower(coalesce(agent_id, '')), 'plate') > 0
   OR instr(lower(coalesce(campaign, '')), 'plate') > 0
   OR instr(lower(coalesce(product_name, '')), 'plate') > 0
   OR instr(lower(coalesce(Type, '')), 'plate') > 0""")
def search_rows(spark, sf):
    return flt.search_rows(labeled(spark, sf), "PLATE", SEARCH_COLS).select("call_id")


# ------------------------------------------------------------------ ordering / projections
@register("newest_first_page", covers="O1 O2 D23", oracle=LABELED_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time FROM labeled
ORDER BY start_time DESC NULLS LAST, call_id LIMIT 25""")
def newest_first_page(spark, sf):
    return (labeled(spark, sf).orderBy(F.col("start_time").desc_nulls_last(), F.col("call_id"))
            .limit(25).select("call_id", fmt_ts("start_time").alias("start_time")))


@register("oldest_first_page", covers="O1 O2 D23", oracle=LABELED_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time FROM labeled
ORDER BY start_time ASC NULLS LAST, call_id LIMIT 25""")
def oldest_first_page(spark, sf):
    return (labeled(spark, sf).orderBy(F.col("start_time").asc_nulls_last(), F.col("call_id"))
            .limit(25).select("call_id", fmt_ts("start_time").alias("start_time")))


def _mask_sql(e: str) -> str:
    from .q_calls import _mask_sql as m
    return m(e)


@register("preview_table", covers="P7 O4 T9", oracle=LABELED_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, agent_id, campaign,
       {_mask_sql('customer_name')} AS customer_name, product_name, quantity, {sr6('amount')} AS amount,
       Connected, Type, Outcome
FROM labeled ORDER BY labeled.start_time DESC NULLS LAST, call_id LIMIT 50""")
def preview_table(spark, sf):
    out = nz.preview_table(labeled(spark, sf), show_pii=False, cap=50,
                           order=[F.col("start_time").desc_nulls_last(), F.col("call_id")])
    return (out.withColumn("start_time", fmt_ts("start_time"))
               .withColumn("amount", r6("amount")))


@register("calls_table", covers="P8", oracle=LABELED_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, agent_id, campaign, Connected, Type, Outcome,
       {sr6('duration_seconds')} AS duration_seconds FROM labeled""")
def calls_table(spark, sf):
    return (nz.calls_table(labeled(spark, sf)).withColumn("start_time", fmt_ts("start_time"))
            .withColumn("duration_seconds", r6("duration_seconds")))


def _summary_sql() -> str:
    m = _mask_sql("customer_name")
    return (f"'Call ' || coalesce(call_id, 'None') || ' • ' || "
            f"coalesce(strftime(start_time, '%Y-%m-%d %H:%M:%S') || '+00:00', 'NaT') || ' • ' || "
            f"coalesce(Connected, 'None') || '/' || coalesce(Type, 'None') || '/' || coalesce(Outcome, 'None') || "
            f"CASE WHEN {m} IS NOT NULL AND {m} <> '' THEN ' • ' || {m} ELSE '' END")


@register("call_summaries", covers="P12", oracle=LABELED_SQL + f"""
SELECT call_id, {_summary_sql()} AS summary FROM labeled""")
def call_summaries(spark, sf):
    df = labeled(spark, sf)
    return df.select("call_id", nz.call_summary(df, pii_mask=True).alias("summary"))


@register("fixed_category_order", covers="O6", oracle=LABELED_SQL + """
SELECT Type, count(*) AS count,
       CASE Type WHEN 'Inquiry' THEN 0 WHEN 'Billing/Sales' THEN 1 WHEN 'Support' THEN 2
                 WHEN 'Complaint' THEN 3 WHEN 'Unknown' THEN 4 ELSE 99 END AS ord
FROM (SELECT coalesce(Type, 'Unknown') AS Type FROM labeled) GROUP BY Type""")
def fixed_category_order(spark, sf):
    out = agg.type_breakdown(labeled(spark, sf), show_unknowns=True)
    return out.withColumn("ord", agg.category_order(F.col("Type"), agg.TYPE_LABELS))


@register("rollup_order", covers="O7 W5", oracle=LABELED_SQL + """
SELECT campaign, total, row_number() OVER (ORDER BY total DESC, campaign) AS position
FROM (SELECT campaign, count(*) AS total FROM labeled GROUP BY campaign)""")
def rollup_order(spark, sf):
    out = agg.by_campaign(labeled(spark, sf)).select("campaign", "total")
    # the rollup has one row per campaign (bounded by the entity count), so a global rank is cheap
    w = Window.orderBy(F.col("total").desc(), F.col("campaign"))
    return out.withColumn("position", F.row_number().over(w))


# ------------------------------------------------------------------ J9 specs with amounts or products only
@register("specs_amounts_products", covers="J9 F6d F6e F6f", oracle=WITH_RAW.rstrip() + """,
avgs AS (SELECT campaign, round(avg(amount)) AS m FROM calls_raw GROUP BY 1),
words AS (SELECT DISTINCT lower(split_part(product_name, ' ', 1)) AS w FROM calls_raw WHERE product_name IS NOT NULL),
specs AS (
  SELECT 'from-' || campaign AS id, m AS lo, NULL AS hi, NULL AS w FROM avgs
  UNION ALL SELECT 'to-' || campaign, NULL, round(m / 2), NULL FROM avgs
  UNION ALL SELECT 'between-' || campaign, m, round(m * 1.2), NULL FROM avgs
  UNION ALL SELECT 'product-' || w, NULL, NULL, w FROM words)
SELECT s.id AS question_id, count(*) AS calls, sum(CAST(call_id AS BIGINT)) AS ids
FROM specs s JOIN calls_raw c ON (lo IS NULL OR amount >= lo) AND (hi IS NULL OR amount <= hi) AND (w IS NULL OR instr(lower(product_name), w) > 0)
GROUP BY 1""")
def specs_amounts_products(spark, sf):
    """Specs whose only condition is an amount, by each campaign's average, or the first word of a product's name."""
    calls = fx.calls(spark, sf)
    none, m = F.lit(None).cast("double"), F.col("m")
    avgs = calls.groupBy("campaign").agg(F.round(F.avg("amount")).alias("m"))
    amounts = avgs.select("campaign", F.inline(F.array(*[F.struct(F.lit(name).alias("kind"), lo.alias("min_amount"), hi.alias("max_amount")) for name, lo, hi in (
        ("from-", m, none), ("to-", none, F.round(m / 2)), ("between-", m, F.round(m * 1.2)))])))
    words = calls.filter("product_name IS NOT NULL").select(F.lower(F.split("product_name", " ")[0]).alias("w")).distinct()
    empty = F.array().cast("array<string>")
    specs = amounts.select(F.concat("kind", "campaign").alias("question_id"), empty.alias("products"), "min_amount", "max_amount").unionByName(
        words.select(F.concat(F.lit("product-"), "w").alias("question_id"), F.array("w").alias("products"), none.alias("min_amount"), none.alias("max_amount")))
    for c in ("type_any", "outcome_any", "agents", "campaigns"):
        specs = specs.withColumn(c, empty)
    specs = specs.withColumn("date_from", F.lit(None).cast("date")).withColumn("date_to", F.lit(None).cast("date"))
    out = flt.apply_specs(calls, specs, TZ)
    return out.groupBy("question_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("call_id").cast("bigint")).alias("ids"))
