"""Registered queries: normalization, gate, text functions, labels, dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import labels as lab
from ..operators import normalize as nz
from . import fixtures as fx
from .common import LABEL_RULES, LABELED_SQL, fmt_ts, gated, labeled, labeled_preferring, r6
from .oracle_sql import (CALLS_RAW_CTE, any_in, fmt_ts as sfmt, guard, label_ctes, neg_re, q,
                         r6 as sr6, tokens as stokens)
from .registry import register

TZ = "Europe/Berlin"
WS = tx.WS_CLASS
WITH_RAW = "WITH " + CALLS_RAW_CTE + "\n"


def _local_ts_sql(e: str) -> str:
    return f"timezone('{TZ}', timezone('UTC', {e}))"


# ------------------------------------------------------------------ P1-P4
@register("normalize_calls", covers="P1 P2 P3 P4", oracle=WITH_RAW + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, {sr6('duration_seconds')} AS duration_seconds,
       agent_id, campaign, customer_name, product_name, {sr6('quantity')} AS quantity, {sr6('amount')} AS amount, order_id,
       CASE WHEN raw_connected IN ('Connected','Disconnected') THEN raw_connected END AS Connected,
       CASE WHEN raw_type IN ('Inquiry','Billing/Sales','Support','Complaint','Unknown') THEN raw_type
            ELSE 'Unknown' END AS Type,
       CASE WHEN raw_outcome IN ('Resolved','Callback','Refund','Sale-close','Unknown') THEN raw_outcome
            ELSE 'Unknown' END AS Outcome
FROM calls_raw""")
def normalize_calls(spark, sf):
    df = nz.normalize_calls(fx.calls_with_raw_labels(spark, sf))
    return df.select("call_id", fmt_ts("start_time").alias("start_time"),
                     r6("duration_seconds").alias("duration_seconds"), "agent_id", "campaign",
                     "customer_name", "product_name", r6("quantity").alias("quantity"), r6("amount").alias("amount"),
                     "order_id", "Connected", "Type", "Outcome")


@register("dq_report", covers="P6", oracle=WITH_RAW.rstrip() + """,
dq_raw AS (SELECT CASE WHEN CAST(call_id AS BIGINT) % 11 = 0 THEN -duration_seconds ELSE duration_seconds END AS duration_seconds,
               CAST(NULL AS TIMESTAMP) AS start_time FROM calls_raw)
SELECT 'Missing columns added as empty: product_name' AS warning UNION ALL
SELECT 'Some rows have negative duration_seconds (will be treated as 0).' FROM dq_raw HAVING bool_or(duration_seconds < 0)
UNION ALL SELECT 'start_time could not be parsed for any rows (check your timestamps).' FROM dq_raw HAVING count(start_time) = 0
UNION ALL SELECT 'Note: product columns are not available in the dataset.'""")
def dq_report(spark, sf):
    """An upload without product names, with some negative durations and times that no row can parse."""
    n = F.col("call_id").cast("bigint")
    df = (fx.calls_with_raw_labels(spark, sf).drop("product_name")
          .withColumn("duration_seconds", F.when(n % 11 == 0, -F.col("duration_seconds")).otherwise(F.col("duration_seconds")))
          .withColumn("start_time", F.concat(F.lit("at "), "call_id")))
    return nz.dq_report(df)


# ------------------------------------------------------------------ F1 gate
@register("gate_included", covers="F1 T2", oracle=WITH_RAW + f"""
SELECT call_id, len({stokens('transcript')}) AS n_tokens FROM calls_raw
WHERE len({stokens('transcript')}) >= 20""")
def gate_included(spark, sf):
    inc, _ = gated(spark, sf)
    return inc.select("call_id", tx.token_count("transcript").alias("n_tokens"))


@register("gate_excluded", covers="F1", oracle=WITH_RAW + f"""
SELECT call_id, 'short/non-English' AS reason FROM calls_raw
WHERE len({stokens('transcript')}) < 20""")
def gate_excluded(spark, sf):
    _, exc = gated(spark, sf)
    return exc


# ------------------------------------------------------------------ T*
@register("token_stats", covers="T1 T2", oracle=f"""
SELECT doc_id, len({stokens('text')}) AS n_tokens,
       sha256(array_to_string({stokens('text')}, ' ')) AS tokens_sha
FROM documents""")
def token_stats(spark, sf):
    d = fx.table(spark, sf, "documents")
    toks = tx.tokens("text")
    return d.select("doc_id", F.size(toks).alias("n_tokens"),
                    F.sha2(F.array_join(toks, " "), 256).alias("tokens_sha"))


@register("tail_text", covers="T5", oracle=f"""
SELECT doc_id, array_to_string(list_slice({stokens('text')},
         CAST(floor(len({stokens('text')}) * 0.75) AS BIGINT) + 1, len({stokens('text')})), ' ') AS tail
FROM documents""")
def tail_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.tail_text("text", 0.25).alias("tail"))


GUARD_PHRASES = ("the", "la", "und", "que")


def _guard_sql():
    cols = []
    for i, p in enumerate(GUARD_PHRASES):
        cols.append(f"instr(lower(coalesce(text,'')), {q(p)}) > 0 AS present_{i}")
        g = guard("lower(coalesce(text,''))", p, fx.WIDE_NEGATION_WORDS)
        cols.append(f"{g} AS guarded_{i}")
    return "SELECT doc_id, " + ", ".join(cols) + " FROM documents"


@register("negation_guard", covers="T3 T4", oracle=_guard_sql())
def negation_guard(spark, sf):
    d = fx.table(spark, sf, "documents")
    lc = F.lower(tx.safe_text("text"))
    cols = []
    for i, p in enumerate(GUARD_PHRASES):
        cols.append(tx.contains_any(lc, [p]).alias(f"present_{i}"))
        cols.append(tx.negation_guard(lc, p, fx.WIDE_NEGATION_WORDS).alias(f"guarded_{i}"))
    return d.select("doc_id", *cols)


def _mask_sql(e: str) -> str:
    parts = f"string_split_regex(regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+')"
    body = (f"array_to_string(list_transform({parts}, lambda p: CASE WHEN length(p) <= 1 THEN p || '*' "
            f"ELSE substr(p, 1, 1) || repeat('*', length(p) - 1) END), ' ')")
    return f"CASE WHEN {e} IS NULL OR regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g') = '' THEN {e} ELSE {body} END"


@register("mask_names", covers="T9", oracle=WITH_RAW + f"""
SELECT call_id, {_mask_sql('customer_name')} AS customer_masked,
       {_mask_sql('product_name')} AS product_masked FROM calls_raw""")
def mask_names(spark, sf):
    c = fx.calls(spark, sf)
    return c.select("call_id", tx.mask_name("customer_name").alias("customer_masked"),
                    tx.mask_name("product_name").alias("product_masked"))


@register("content_keys", covers="T7", oracle=WITH_RAW + """
SELECT call_id, sha256(transcript) AS transcript_sha,
       sha256(concat_ws('||', call_id, agent_id, campaign)) AS cache_key FROM calls_raw""")
def content_keys(spark, sf):
    c = fx.calls(spark, sf)
    return c.select("call_id", tx.sha256_hex("transcript").alias("transcript_sha"),
                    tx.key_from_parts("call_id", "agent_id", "campaign").alias("cache_key"))


@register("text_normalize", covers="T6 T10 T11", oracle=f"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'),
                                     '^{WS}+|{WS}+$', '', 'g')) AS ws_sha,
       lower(regexp_replace(source, '^{WS}+|{WS}+$', '', 'g')) AS source_key,
       coalesce(CAST(lang AS VARCHAR), '') AS lang_str
FROM documents""")
def text_normalize(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(tx.normalize_ws("text"), 256).alias("ws_sha"),
                    tx.norm_key("source").alias("source_key"), tx.str_or_empty("lang").alias("lang_str"))


@register("local_dates", covers="T13", oracle=WITH_RAW + f"""
SELECT call_id, CAST(CAST({_local_ts_sql('start_time')} AS DATE) AS VARCHAR) AS local_day,
       strftime({_local_ts_sql('start_time')}, '%Y-%m-%d %H:%M:%S') AS local_time
FROM calls_raw""")
def local_dates(spark, sf):
    c = fx.calls(spark, sf)
    return c.select("call_id", tx.local_date("start_time", TZ).cast("string").alias("local_day"),
                    fmt_ts(F.from_utc_timestamp("start_time", TZ)).alias("local_time"))


# ------------------------------------------------------------------ labels
@register("label_connected", covers="L1", oracle=LABELED_SQL + "SELECT call_id, Connected FROM labeled")
def label_connected(spark, sf):
    return labeled(spark, sf).select("call_id", "Connected")


@register("label_type", covers="L2 L3", oracle=LABELED_SQL + "SELECT call_id, Type FROM labeled")
def label_type(spark, sf):
    return labeled(spark, sf).select("call_id", "Type")


@register("label_outcome", covers="L4", oracle=LABELED_SQL + "SELECT call_id, Outcome FROM labeled")
def label_outcome(spark, sf):
    return labeled(spark, sf).select("call_id", "Outcome")


@register("labels_all", covers="L5", oracle=LABELED_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, {sr6('duration_seconds')} AS duration_seconds,
       agent_id, Connected, Type, Outcome FROM labeled""")
def labels_all(spark, sf):
    return labeled(spark, sf).select("call_id", fmt_ts("start_time").alias("start_time"),
                                     r6("duration_seconds").alias("duration_seconds"),
                                     "agent_id", "Connected", "Type", "Outcome")


def _prefer_sql(col: str, raw: str, labels: list[str]) -> str:
    inset = ", ".join(q(x) for x in labels)
    norm = f"(CASE WHEN {raw} IN ({inset}) THEN {raw} ELSE 'Unknown' END)"
    return (f"CASE WHEN trim({norm}) <> '' AND lower(trim({norm})) <> 'unknown' THEN {norm} "
            f"ELSE {col} END")


@register("prefer_existing", covers="P11 L9", oracle=LABELED_SQL + f"""
SELECT call_id, Connected,
       {_prefer_sql('Type', 'raw_type', ['Inquiry', 'Billing/Sales', 'Support', 'Complaint', 'Unknown'])} AS Type,
       {_prefer_sql('Outcome', 'raw_outcome', ['Resolved', 'Callback', 'Refund', 'Sale-close', 'Unknown'])} AS Outcome
FROM labeled""")
def prefer_existing(spark, sf):
    return labeled_preferring(spark, sf).select("call_id", "Connected", "Type", "Outcome")


def _hits_sql(guarded: bool, cap: int) -> str:
    items = []
    for label, phrases in LABEL_RULES.types:
        for kw in phrases:
            cond = guard("lc", kw) if guarded else f"instr(lc, {q(kw.lower())}) > 0"
            items.append(f"CASE WHEN {cond} THEN {q(f'[{label}] …{kw}…')} END")
    for label in LABEL_RULES.explain_outcome_order:
        for ph in LABEL_RULES.outcome_phrases(label):
            cond = guard("lc", ph) if guarded else f"instr(lc, {q(ph.lower())}) > 0"
            items.append(f"CASE WHEN {cond} THEN {q(f'[{label}] …{ph}…')} END")
    arr = "[" + ", ".join(items) + "]"
    return (f"array_to_string(list_slice(list_filter({arr}, lambda x: x IS NOT NULL), 1, {cap}), ' | ')")


@register("explain_hits", covers="L6", oracle=WITH_RAW + f"""
SELECT call_id, {_hits_sql(True, 5)} AS hits
FROM (SELECT call_id, lower(coalesce(transcript, '')) AS lc FROM calls_raw)""")
def explain_hits(spark, sf):
    c = fx.calls(spark, sf)
    return c.select("call_id", F.array_join(lab.explain_matches("transcript", LABEL_RULES, 5), " | ")
                    .alias("hits"))


@register("collect_hits", covers="L7", oracle=WITH_RAW + f"""
SELECT call_id, {_hits_sql(False, 5)} AS hits
FROM (SELECT call_id, lower(coalesce(transcript, '')) AS lc FROM calls_raw)""")
def collect_hits(spark, sf):
    c = fx.calls(spark, sf)
    return c.select("call_id", F.array_join(lab.collect_hits("transcript", LABEL_RULES, 5), " | ")
                    .alias("hits"))


def _rule_hits_sql() -> str:
    parts = []
    for kind, groups in (("type", LABEL_RULES.types), ("outcome", LABEL_RULES.outcomes)):
        for label, phrases in groups:
            for p in phrases:
                parts.append(f"SELECT {q(kind)} AS kind, {q(label)} AS label, {q(p)} AS phrase, "
                             f"count(*) AS n_calls FROM g WHERE {guard('lc', p)} HAVING count(*) > 0")
    return (WITH_RAW.rstrip() + f""",
g AS (SELECT lower(coalesce(transcript, '')) AS lc FROM calls_raw
      WHERE len({stokens('transcript')}) >= 20)
""" + "\nUNION ALL\n".join(parts))


@register("rule_hit_counts", covers="L8", oracle=_rule_hits_sql())
def rule_hit_counts(spark, sf):
    inc, _ = gated(spark, sf)
    return lab.rule_hit_counts(inc, LABEL_RULES)


# ------------------------------------------------------------------ rules as a table
TABLE_RULES_SQL = WITH_RAW.rstrip() + f""",
g AS (SELECT call_id, lower(coalesce(transcript, '')) AS lc FROM calls_raw WHERE len({stokens('transcript')}) >= 20),
words AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS phrase FROM benchmark),
rules AS (SELECT phrase, substr(phrase, 1, 1) AS label, row_number() OVER (ORDER BY phrase) - 1 AS place FROM words
          WHERE regexp_full_match(phrase, '[a-z]{{3,}}')),
hits AS (SELECT g.call_id, r.label, r.phrase, r.place,
                substr(g.lc, greatest(1, instr(g.lc, r.phrase) - 20), instr(g.lc, r.phrase) - greatest(1, instr(g.lc, r.phrase) - 20)) AS win
         FROM g JOIN rules r ON instr(g.lc, r.phrase) > 0),
clear AS (SELECT * FROM hits WHERE NOT regexp_matches(win, {q(neg_re())}))
"""


def word_rules(spark, sf):
    """A rule for every plain word of the benchmark items, labeled by its first letter: far more than a rule set spells out."""
    words = fx.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("phrase")).distinct()
    words = words.filter(F.col("phrase").rlike("^[a-z]{3,}$"))
    # one task orders the vocabulary, the calls never
    place = F.row_number().over(Window.orderBy("phrase")) - 1
    return words.select(F.lit("type").alias("kind"), F.substring("phrase", 1, 1).alias("label"), "phrase", place.cast("bigint").alias("place"))


@register("rule_table_counts", covers="L8", oracle=TABLE_RULES_SQL + """
SELECT 'type' AS kind, label, phrase, count(*) AS n_calls FROM clear GROUP BY label, phrase""")
def rule_table_counts(spark, sf):
    return lab.table_hit_counts(gated(spark, sf)[0], word_rules(spark, sf))


@register("rule_table_explain", covers="L6", oracle=TABLE_RULES_SQL + """
SELECT call_id, string_agg('[' || label || '] …' || phrase || '…', ' ' ORDER BY place) AS matches FROM (
  SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY place) AS n FROM clear) WHERE n <= 5 GROUP BY call_id""")
def rule_table_explain(spark, sf):
    out = lab.explain_by_table(gated(spark, sf)[0], word_rules(spark, sf), 5)
    return out.select("call_id", F.array_join("matches", " ").alias("matches"))


# ------------------------------------------------------------------ aggregates
def _top_sql(key: str, col: str, src: str = "labeled") -> str:
    return f"""(SELECT {key}, {col} FROM (
      SELECT {key}, {col}, row_number() OVER (PARTITION BY {key}
             ORDER BY ({col} = 'Unknown'), n DESC, {col}) AS rn
      FROM (SELECT {key}, {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {key}, {col}))
    WHERE rn = 1)"""


def _by_dim_sql(key: str) -> str:
    return LABELED_SQL + f"""
SELECT a.{key}, a.total,
       round(a.c * 100.0 / greatest(1, a.c + a.d), 6) AS pct_connected,
       t.Type AS top_type, o.Outcome AS top_outcome
FROM (SELECT {key}, count(*) AS total, count(*) FILTER (WHERE Connected = 'Connected') AS c,
             count(*) FILTER (WHERE Connected = 'Disconnected') AS d
      FROM labeled GROUP BY {key}) a
LEFT JOIN {_top_sql(key, 'Type')} t ON t.{key} IS NOT DISTINCT FROM a.{key}
LEFT JOIN {_top_sql(key, 'Outcome')} o ON o.{key} IS NOT DISTINCT FROM a.{key}"""


@register("by_agent", covers="A6 A8 W5 O7", oracle=_by_dim_sql("agent_id"))
def by_agent(spark, sf):
    return agg.by_agent(labeled(spark, sf)).withColumn("pct_connected", r6("pct_connected"))


@register("by_campaign", covers="A7", oracle=_by_dim_sql("campaign"))
def by_campaign(spark, sf):
    return agg.by_campaign(labeled(spark, sf)).withColumn("pct_connected", r6("pct_connected"))


def _mode_sql(col: str, where: str = "TRUE") -> str:
    return (f"(SELECT {col} FROM labeled WHERE {col} IS NOT NULL AND {where} GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


@register("kpis", covers="A1", oracle=LABELED_SQL + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE Connected = 'Connected') AS connected,
       count(*) FILTER (WHERE Connected = 'Disconnected') AS disconnected,
       round(count(*) FILTER (WHERE Connected = 'Connected') * 100.0 /
             greatest(1, count(*) FILTER (WHERE Connected IN ('Connected', 'Disconnected'))), 6)
         AS pct_connected,
       {_mode_sql('Type', "Type <> 'Unknown'")} AS top_type,
       {_mode_sql('Outcome', "Outcome <> 'Unknown'")} AS top_outcome
FROM labeled""")
def kpis(spark, sf):
    return agg.kpis(labeled(spark, sf)).withColumn("pct_connected", r6("pct_connected"))


@register("kpi_tiles", covers="A2", oracle=LABELED_SQL + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE Connected = 'Connected') AS connected,
       count(*) FILTER (WHERE Connected = 'Disconnected') AS disconnected,
       round(count(*) FILTER (WHERE Connected = 'Connected') * 100.0 /
             greatest(1, count(*) FILTER (WHERE Connected IN ('Connected', 'Disconnected'))), 6)
         AS pct_connected,
       {_mode_sql('Type')} AS top_type, {_mode_sql('Outcome')} AS top_outcome,
       (SELECT count(*) FROM calls_raw WHERE len({stokens('transcript')}) < 20) AS excluded
FROM labeled""")
def kpi_tiles(spark, sf):
    calls = lab.apply_labels(flt.flagged(fx.calls(spark, sf)), LABEL_RULES)
    return agg.flagged_tiles(calls).withColumn("pct_connected", r6("pct_connected"))


@register("connection_breakdown", covers="A3 O6", oracle=LABELED_SQL + """
SELECT coalesce(Connected, 'Unknown') AS Connected, count(*) AS count FROM labeled GROUP BY 1""")
def connection_breakdown(spark, sf):
    return agg.connection_breakdown(labeled(spark, sf))


@register("type_breakdown", covers="A4", oracle=LABELED_SQL + """
SELECT coalesce(Type, 'Unknown') AS Type, count(*) AS count FROM labeled GROUP BY 1
HAVING coalesce(Type, 'Unknown') <> 'Unknown'""")
def type_breakdown(spark, sf):
    return agg.type_breakdown(labeled(spark, sf))


@register("outcome_breakdown", covers="A5", oracle=LABELED_SQL + """
SELECT coalesce(Outcome, 'Unknown') AS Outcome, count(*) AS count FROM labeled GROUP BY 1
HAVING coalesce(Outcome, 'Unknown') <> 'Unknown'""")
def outcome_breakdown(spark, sf):
    return agg.outcome_breakdown(labeled(spark, sf))


def _ord_sql(e: str, order: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {e} = {q(v)} THEN {i}" for i, v in enumerate(order)) + " ELSE 99 END"


_SECTIONS_SQL = f"""
sections AS (
  SELECT 'Connection' AS section, coalesce(Connected, 'Unknown') AS label, count(*) AS count,
         {_ord_sql("coalesce(Connected, 'Unknown')", ['Connected', 'Disconnected', 'Unknown'])} AS ord
  FROM labeled GROUP BY 2
  UNION ALL
  SELECT 'Types', coalesce(Type, 'Unknown'), count(*),
         {_ord_sql("coalesce(Type, 'Unknown')", ['Inquiry', 'Billing/Sales', 'Support', 'Complaint', 'Unknown'])}
  FROM labeled GROUP BY 2
  UNION ALL
  SELECT 'Outcomes', coalesce(Outcome, 'Unknown'), count(*),
         {_ord_sql("coalesce(Outcome, 'Unknown')", ['Resolved', 'Callback', 'Refund', 'Sale-close', 'Unknown'])}
  FROM labeled GROUP BY 2)
"""


@register("breakdowns_one_pass", covers="A9", oracle=LABELED_SQL.rstrip() + "," + _SECTIONS_SQL + """
SELECT section, label, count, ord FROM sections""")
def breakdowns_one_pass(spark, sf):
    return agg.breakdowns_one_pass(labeled(spark, sf), show_unknowns=True)


SUMMARY_CONTEXT = {"timezone": TZ, "rules": "test profile"}


@register("summary_sections", covers="A10 S7", oracle=LABELED_SQL.rstrip() + "," + _SECTIONS_SQL + """
SELECT section, label, CAST(count AS VARCHAR) AS count FROM sections
WHERE section = 'Connection' OR label <> 'Unknown'
UNION ALL SELECT '', '', ''
UNION ALL SELECT 'Context', 'timezone', 'Europe/Berlin'
UNION ALL SELECT 'Context', 'rules', 'test profile'""")
def summary_sections(spark, sf):
    return agg.summary_sections(labeled(spark, sf), SUMMARY_CONTEXT, show_unknowns=False)


@register("entity_catalog", covers="A12 U3", oracle=WITH_RAW + """
SELECT DISTINCT kind, value FROM (
  SELECT 'agent' AS kind, trim(agent_id) AS value FROM calls_raw
  UNION ALL SELECT 'campaign', trim(campaign) FROM calls_raw
  UNION ALL SELECT 'product', trim(product_name) FROM calls_raw)
WHERE value IS NOT NULL AND value <> ''""")
def entity_catalog(spark, sf):
    return agg.entity_catalog(fx.calls(spark, sf))


@register("filter_options", covers="A13", oracle=WITH_RAW + """
SELECT DISTINCT kind, value FROM (
  SELECT 'agent' AS kind, agent_id AS value FROM calls_raw
  UNION ALL SELECT 'campaign', campaign FROM calls_raw)
WHERE value IS NOT NULL AND value <> ''""")
def filter_options(spark, sf):
    return agg.filter_options(fx.calls(spark, sf))


@register("date_extent", covers="A14", oracle=WITH_RAW + f"""
SELECT CAST(min(CAST({_local_ts_sql('start_time')} AS DATE)) AS VARCHAR) AS min_date,
       CAST(max(CAST({_local_ts_sql('start_time')} AS DATE)) AS VARCHAR) AS max_date FROM calls_raw""")
def date_extent(spark, sf):
    return agg.date_extent(fx.calls(spark, sf), TZ).select(
        F.col("min_date").cast("string").alias("min_date"), F.col("max_date").cast("string").alias("max_date"))


@register("batch_report", covers="A15", oracle=LABELED_SQL + f"""
SELECT (SELECT count(*) FROM labeled) AS included,
       (SELECT count(*) FROM labeled WHERE Connected = 'Connected') AS connected,
       (SELECT count(*) FROM labeled WHERE Connected = 'Disconnected') AS disconnected,
       (SELECT count(*) FROM calls_raw WHERE len({stokens('transcript')}) < 20) AS excluded""")
def batch_report(spark, sf):
    return agg.flagged_report(lab.apply_labels(flt.flagged(fx.calls(spark, sf)), LABEL_RULES))
