"""Registered queries: question parsing (Q1–Q10), entity grounding (J3/J4), answering.

The question table has one question per campaign and call month, phrased with one of eight
templates, and one for every user turn of ``conversations``: the turn's ASCII words with a
date and an amount phrase, asked on a day by its conversation. So it grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import questions as qx
from . import fixtures as fx
from .common import LABELED_SQL, labeled
from .oracle_sql import CALLS_RAW_CTE, q
from .registry import register

TZ = "Europe/Berlin"


# ------------------------------------------------------------------ question table
def questions(spark, sf):
    c = fx.calls(spark, sf).filter(F.col("start_time").isNotNull() & F.col("campaign").isNotNull())
    g = (c.groupBy("campaign", F.date_format("start_time", "yyyy-MM").alias("ym"))
          .agg(F.coalesce(F.min("agent_id"), F.lit("none")).alias("agent"),
               F.coalesce(F.min("product_name"), F.lit("none")).alias("product")))
    d = F.to_date(F.concat(F.col("ym"), F.lit("-01")))
    y, m = F.year(d).cast("string"), F.date_format(d, "MM")
    mon, month = F.date_format(d, "MMM"), F.date_format(d, "MMMM")
    key = F.concat(F.col("campaign"), F.lit("|"), F.col("ym"))
    form = F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int") % 8
    rel = (F.when(F.month(d) % 4 == 0, "this week").when(F.month(d) % 4 == 1, "last week")
            .when(F.month(d) % 4 == 2, "this month").otherwise("last month"))
    text = (F.when(form == 0, F.concat(F.lit("sales calls on "), y, F.lit("-"), m, F.lit("-15 for agent "), F.col("agent")))
             .when(form == 1, F.concat(F.lit("refunds between 10/"), m, F.lit("/"), y, F.lit(" and 20/"), m, F.lit("/"), y,
                                       F.lit(" in "), F.lower("campaign")))
             .when(form == 2, F.concat(F.lit("support calls from 3 "), mon, F.lit(" "), y, F.lit(" to "), mon,
                                       F.lit(" 25 "), y, F.lit(" by rep "), F.col("agent")))
             .when(form == 3, F.lit("complaints last 7 days with amount 100-500"))
             .when(form == 4, F.concat(F.lit("show me everything for yesterday, agent "), F.col("agent")))
             .when(form == 5, F.concat(F.lit("resolved or fixed calls "), rel, F.lit(" min 1000")))
             .when(form == 6, F.concat(F.lit("calls of "), month, F.lit(" "), y, F.lit(" about "), F.col("product"),
                                       F.lit(" between 1000 and 5000")))
             .otherwise(F.concat(F.lit("outcome is sale-close for "), F.col("campaign"), F.lit(" in "),
                                 F.lower(month), F.lit(" >= 50000"))))
    asked = g.select(key.alias("question_id"), text.alias("text"), F.date_add(d, 20).alias("as_of"))
    return asked.unionByName(turn_questions(spark, sf))


def turn_questions(spark, sf):
    """A question for every user turn."""
    t = fx.table(spark, sf, "conversations").filter("role = 'user' and text is not null")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("conv_id") * 37 % 1800).cast("int"))
    phrase = (F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" calls on "), day.cast("string")))
              .when(F.col("conv_id") % 3 == 1, F.lit(" calls of the last 9 days min 2000"))
              .otherwise(F.lit(" refunds this week")))
    words = F.regexp_replace("text", "[^A-Za-z]+", " ")
    return t.select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("question_id"),
                    F.concat(words, phrase).alias("text"), day.alias("as_of"))


QUESTIONS_SQL = "WITH " + CALLS_RAW_CTE + """,
qsrc AS (
  SELECT campaign, strftime(start_time, '%Y-%m') AS ym, coalesce(min(agent_id), 'none') AS agent,
         coalesce(min(product_name), 'none') AS product
  FROM calls_raw WHERE start_time IS NOT NULL AND campaign IS NOT NULL GROUP BY 1, 2),
qd AS (SELECT *, CAST(ym || '-01' AS DATE) AS d, campaign || '|' || ym AS question_id,
              ('0x' || substr(md5(campaign || '|' || ym), 1, 2))::INTEGER % 8 AS form FROM qsrc),
qv AS (SELECT *, CAST(year(d) AS VARCHAR) AS y, strftime(d, '%m') AS m, strftime(d, '%b') AS mon,
              strftime(d, '%B') AS month_name,
              CASE month(d) % 4 WHEN 0 THEN 'this week' WHEN 1 THEN 'last week' WHEN 2 THEN 'this month'
                   ELSE 'last month' END AS rel FROM qd),
turns AS (
  SELECT *, DATE '1995-01-01' + CAST(conv_id * 37 % 1800 AS INTEGER) AS day FROM conversations WHERE role = 'user' AND text IS NOT NULL),
questions AS (
  SELECT 'turn-' || conv_id || '-' || turn AS question_id, CAST(day AS TIMESTAMP) AS as_of_ts,
         regexp_replace(text, '[^A-Za-z]+', ' ', 'g') || CASE conv_id % 3
           WHEN 0 THEN ' calls on ' || CAST(day AS VARCHAR) WHEN 1 THEN ' calls of the last 9 days min 2000'
           ELSE ' refunds this week' END AS text FROM turns
  UNION ALL
  SELECT question_id, d + INTERVAL 20 DAY AS as_of_ts,
         CASE form
           WHEN 0 THEN 'sales calls on ' || y || '-' || m || '-15 for agent ' || agent
           WHEN 1 THEN 'refunds between 10/' || m || '/' || y || ' and 20/' || m || '/' || y || ' in ' || lower(campaign)
           WHEN 2 THEN 'support calls from 3 ' || mon || ' ' || y || ' to ' || mon || ' 25 ' || y || ' by rep ' || agent
           WHEN 3 THEN 'complaints last 7 days with amount 100-500'
           WHEN 4 THEN 'show me everything for yesterday, agent ' || agent
           WHEN 5 THEN 'resolved or fixed calls ' || rel || ' min 1000'
           WHEN 6 THEN 'calls of ' || month_name || ' ' || y || ' about ' || product || ' between 1000 and 5000'
           ELSE 'outcome is sale-close for ' || campaign || ' in ' || lower(month_name) || ' >= 50000' END AS text
  FROM qv),
qq AS (SELECT question_id, text, CAST(as_of_ts AS DATE) AS as_of, lower(text) AS s FROM questions)"""


# ------------------------------------------------------------------ SQL mirrors of the parsers
def _g(s: str, pat: str, i: int) -> str:
    return f"nullif(regexp_extract({s}, {q(pat)}, {i}), '')"


MONTH_CASE_ITEMS = qx.MONTHS


def _month_sql(e: str) -> str:
    return "(CASE lower(" + e + ") " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in MONTH_CASE_ITEMS.items()) + " END)"


def _valid_date_sql(y: str, m: str, d: str) -> str:
    return (f"(CASE WHEN ({m}) BETWEEN 1 AND 12 AND ({d}) >= 1 THEN "
            f"CASE WHEN ({d}) <= day(last_day(make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), 1))) "
            f"THEN make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), CAST({d} AS BIGINT)) END END)")


def _first_date_sql(frag: str) -> str:
    s = f"regexp_replace(regexp_replace({frag}, ',', ' ', 'g'), '^{qx.tx.WS_CLASS}+|{qx.tx.WS_CLASS}+$', '', 'g')"
    iso = _valid_date_sql(f"CAST({_g(s, qx.ISO_RE, 1)} AS INTEGER)", f"CAST({_g(s, qx.ISO_RE, 2)} AS INTEGER)",
                          f"CAST({_g(s, qx.ISO_RE, 3)} AS INTEGER)")
    a = f"CAST({_g(s, qx.DMY_RE, 1)} AS INTEGER)"
    b = f"CAST({_g(s, qx.DMY_RE, 2)} AS INTEGER)"
    y = f"CAST({_g(s, qx.DMY_RE, 3)} AS INTEGER)"
    day = f"(CASE WHEN {a} <= 12 AND {b} <= 12 THEN {a} WHEN {a} <= 12 THEN {b} ELSE {a} END)"
    mon = f"(CASE WHEN {a} <= 12 AND {b} <= 12 THEN {b} WHEN {a} <= 12 THEN {a} ELSE {b} END)"
    dmy = _valid_date_sql(y, mon, day)
    m3 = _month_sql(_g(s, qx.D_MON_Y_RE, 2))
    dmyw = _valid_date_sql(f"CAST({_g(s, qx.D_MON_Y_RE, 3)} AS INTEGER)", m3,
                           f"CAST({_g(s, qx.D_MON_Y_RE, 1)} AS INTEGER)")
    m4 = _month_sql(_g(s, qx.MON_D_Y_RE, 1))
    mdyw = _valid_date_sql(f"CAST({_g(s, qx.MON_D_Y_RE, 3)} AS INTEGER)", m4,
                           f"CAST({_g(s, qx.MON_D_Y_RE, 2)} AS INTEGER)")
    return (f"(CASE WHEN regexp_matches({s}, {q(qx.ISO_RE)}) THEN {iso} "
            f"WHEN regexp_matches({s}, {q(qx.DMY_RE)}) THEN {dmy} "
            f"WHEN regexp_matches({s}, {q(qx.D_MON_Y_RE)}) AND {m3} IS NOT NULL THEN {dmyw} "
            f"WHEN regexp_matches({s}, {q(qx.MON_D_Y_RE)}) AND {m4} IS NOT NULL THEN {mdyw} END)")


def _dates_sql() -> str:
    s = "s"
    hint = "(" + " OR ".join(f"instr(s, {q(h)}) > 0" for h in qx.RANGE_HINTS) + ")"
    parts = []
    for i, (pat, extra) in enumerate(((r"between\s+(.*?)\s+and\s+(.*)", None),
                                      (r"from\s+(.*?)\s+to\s+(.*)", None),
                                      (r"(.*?)\s+-\s+(.*)", hint))):
        d1 = _first_date_sql(f"regexp_extract(s, {q(pat)}, 1)")
        d2 = _first_date_sql(f"regexp_extract(s, {q(pat)}, 2)")
        cond = f"regexp_matches(s, {q(pat)})" + (f" AND {extra}" if extra else "")
        parts.append((cond, d1, d2))
    single = _first_date_sql("s")
    monday_off = "((dayofweek(as_of) + 6) % 7)"            # DuckDB: Sunday=0
    lwe = f"(as_of - CAST({monday_off} + 1 AS INTEGER))"
    tws = f"(as_of - CAST({monday_off} AS INTEGER))"
    ndays = "regexp_extract(s, '(last|past)\\s+(\\d{1,3})\\s+days?', 2)"
    no_explicit = "NOT (" + " OR ".join(f"regexp_matches(s, {q(p)})" for p in
                                        (qx.ISO_RE, qx.DMY_RE, qx.D_MON_Y_RE, qx.MON_D_Y_RE)) + ")"
    my_mon = _month_sql(_g(s, qx.MON_Y_RE, 1))
    my_year = f"CAST({_g(s, qx.MON_Y_RE, 2)} AS INTEGER)"
    mo_mon = _month_sql(_g(s, qx.MONTH_ONLY_RE, 1))
    my_start = f"make_date({my_year}, {my_mon}, 1)"
    mo_start = f"make_date(year(as_of), {mo_mon}, 1)"
    rows = [
        (f"{parts[0][0]} AND {parts[0][1]} IS NOT NULL AND {parts[0][2]} IS NOT NULL",
         f"least({parts[0][1]}, {parts[0][2]})", f"greatest({parts[0][1]}, {parts[0][2]})", "range"),
        (f"{parts[1][0]} AND {parts[1][1]} IS NOT NULL AND {parts[1][2]} IS NOT NULL",
         f"least({parts[1][1]}, {parts[1][2]})", f"greatest({parts[1][1]}, {parts[1][2]})", "range"),
        (f"{parts[2][0]} AND {parts[2][1]} IS NOT NULL AND {parts[2][2]} IS NOT NULL",
         f"least({parts[2][1]}, {parts[2][2]})", f"greatest({parts[2][1]}, {parts[2][2]})", "range"),
        (f"{single} IS NOT NULL", single, single, "date"),
        ("instr(s, 'today') > 0", "as_of", "as_of", "today"),
        ("instr(s, 'yesterday') > 0", "as_of - 1", "as_of - 1", "yesterday"),
        (f"{ndays} <> ''", f"as_of - CAST({ndays} AS INTEGER)", "as_of", "last_n_days"),
        ("instr(s, 'last week') > 0", f"{lwe} - 6", lwe, "last_week"),
        ("instr(s, 'this week') > 0", tws, f"least({tws} + 6, as_of)", "this_week"),
        ("instr(s, 'last month') > 0", "CAST(date_trunc('month', CAST(date_trunc('month', as_of) AS DATE) - 1) AS DATE)",
         "CAST(date_trunc('month', as_of) AS DATE) - 1", "last_month"),
        ("instr(s, 'this month') > 0", "CAST(date_trunc('month', as_of) AS DATE)", "as_of", "this_month"),
        (f"{my_mon} IS NOT NULL AND {no_explicit}", my_start, f"last_day({my_start})", "month_year"),
        (f"{mo_mon} IS NOT NULL AND {no_explicit}", mo_start, f"last_day({mo_start})", "month"),
    ]
    f_case = "CASE " + " ".join(f"WHEN {c} THEN CAST({a} AS DATE)" for c, a, _, _ in rows) + " END"
    t_case = "CASE " + " ".join(f"WHEN {c} THEN CAST({b} AS DATE)" for c, _, b, _ in rows) + " END"
    k_case = "CASE " + " ".join(f"WHEN {c} THEN {q(k)}" for c, _, _, k in rows) + " END"
    return f"{f_case} AS date_from, {t_case} AS date_to, {k_case} AS kind"


def _type_sql() -> str:
    hits = []
    for i, (pat, label) in enumerate(qx.TYPE_PATTERNS):
        pos = f"(length(regexp_extract(s, {q('^(.*?)(' + pat + ')')}, 1)) + 1)"
        if label is not None:
            lab = q(label)
        else:
            word = f"regexp_extract(s, {q(pat)}, 1)"
            lab = "(CASE " + " ".join(f"WHEN {word} = {q(w)} THEN {q(l)}" for w, l in qx.TYPE_WORDS.items()) + " END)"
        hits.append(f"CASE WHEN regexp_matches(s, {q(pat)}) AND {lab} IS NOT NULL "
                    f"THEN {{'pos': {pos}, 'ord': {i}, 'label': {lab}}} END")
    best = f"list_min(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))"
    syn = []
    for phrase, mapping in qx.SYNONYMS:
        vals = [v for v in mapping.get("type_any", []) if v in qx.TYPE_CANONICAL]
        if vals:
            syn.append(f"WHEN instr(s, {q(phrase.lower())}) > 0 THEN {q(vals[0])}")
    return f"coalesce(({best}).label, CASE {' '.join(syn)} END)"


def _title_sql(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({e}, ''), lambda ch, i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(coalesce(string_split({e}, '')[i - 1], ''), '^[A-Za-z]$') THEN upper(ch) "
            f"ELSE lower(ch) END), '')")


def _outcomes_sql() -> str:
    items = []
    for pat, label in qx.OUTCOME_PATTERNS:
        if label is not None:
            items.append(f"[CASE WHEN regexp_matches(s, {q(pat)}) THEN {q(label)} END]")
        else:
            grp = f"regexp_replace(regexp_extract(s, {q(pat)}, 1), '^{qx.tx.WS_CLASS}+|{qx.tx.WS_CLASS}+$', '', 'g')"
            items.append(f"[CASE WHEN regexp_matches(s, {q(pat)}) THEN {_title_sql(grp)} END]")
    for phrase, mapping in qx.SYNONYMS:
        vals = mapping.get("outcome_any", [])
        if vals:
            arr = "[" + ", ".join(q(v) for v in vals) + "]"
            items.append(f"CASE WHEN instr(s, {q(phrase.lower())}) > 0 THEN {arr} ELSE []::VARCHAR[] END")
    flat = f"flatten([{', '.join(items)}])"
    # order-preserving de-dup: keep an element when it does not occur earlier
    nn = f"list_filter({flat}, lambda x: x IS NOT NULL)"
    dedup = f"list_filter({nn}, lambda x, i: list_position({nn}, x) = i)"
    canon = "[" + ", ".join(q(v) for v in qx.OUTCOME_CANONICAL) + "]"
    return (f"CASE WHEN len(list_filter({dedup}, lambda x: list_contains({canon}, x))) > 0 "
            f"THEN list_filter({dedup}, lambda x: list_contains({canon}, x)) ELSE {dedup} END")


def _after_words_sql() -> str:
    parts = []
    for w in qx.AFTER_WORDS:
        pat = r"(?i)\b" + w + r"\s+([A-Za-z0-9][A-Za-z0-9_\- ]{0,64})"
        s = "(' ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || ' ')"
        parts.append(f"list_transform(regexp_extract_all({s}, {q(pat)}, 1), lambda f: array_to_string("
                     f"list_slice(list_filter(string_split_regex(f, '\\s+'), lambda t: t <> ''), 1, "
                     f"{qx.AFTER_MAX_TOKENS}), ' '))")
    return f"list_filter(flatten([{', '.join(parts)}]), lambda x: x <> '')"


def _amounts_sql() -> str:
    s = "lower(text)"
    s = f"replace(replace({s}, '–', '-'), '—', '-')"
    for pat in (qx.ISO_RE, qx.DMY_RE, qx.D_MON_Y_RE, qx.MON_D_Y_RE):
        s = f"regexp_replace({s}, {q(pat)}, ' ', 'g')"
    num = qx.NUM

    def n(e):
        return f"CAST(replace({e}, ',', '.') AS DOUBLE)"
    p1 = r"\$?\s*" + num + r"\s*-\s*\$?\s*" + num
    p2 = r"between\s+" + num + r"\s+and\s+" + num
    p3 = r"from\s+\$?\s*" + num + r"\s+to\s+\$?\s*" + num
    lo = f"coalesce({n(_g('a', r'\bmin\s*' + num, 1))}, {n(_g('a', r'>=\s*' + num, 1))})"
    hi = f"coalesce({n(_g('a', r'\bmax\s*' + num, 1))}, {n(_g('a', r'(?:<=|≤)\s*' + num, 1))})"
    lo_case = "CASE " + " ".join(
        f"WHEN regexp_matches(a, {q(p)}) THEN least({n(_g('a', p, 1))}, {n(_g('a', p, 2))})" for p in (p1, p2, p3)
    ) + f" ELSE {lo} END"
    hi_case = "CASE " + " ".join(
        f"WHEN regexp_matches(a, {q(p)}) THEN greatest({n(_g('a', p, 1))}, {n(_g('a', p, 2))})" for p in (p1, p2, p3)
    ) + f" ELSE {hi} END"
    return s, lo_case, hi_case


AMT_S, AMT_LO, AMT_HI = _amounts_sql()

PARSED_SQL = QUESTIONS_SQL + f""",
parsed AS (
  SELECT question_id, text, as_of, {_dates_sql()}, {_type_sql()} AS type_label,
         {_outcomes_sql()} AS outcomes, {_after_words_sql()} AS agent_words
  FROM qq),
amt AS (SELECT question_id, {AMT_LO} AS min_amount, {AMT_HI} AS max_amount
        FROM (SELECT question_id, {AMT_S} AS a FROM qq))"""


def parsed(spark, sf):
    return qx.parse_questions(questions(spark, sf))


@register("question_dates", covers="Q1 Q2 Q3 Q4 D26 D27 D28", oracle=PARSED_SQL + """
SELECT question_id, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to FROM parsed""")
def question_dates(spark, sf):
    return parsed(spark, sf).select("question_id", F.col("date_from").cast("string").alias("date_from"),
                                    F.col("date_to").cast("string").alias("date_to"))


@register("question_types", covers="Q5", oracle=PARSED_SQL + """
SELECT question_id, type_label FROM parsed""")
def question_types(spark, sf):
    p = parsed(spark, sf)
    return p.select("question_id", F.try_element_at(F.col("type_any"), F.lit(1)).alias("type_label"))


@register("question_outcomes", covers="Q6 Q7 U4 D30", oracle=PARSED_SQL + """
SELECT question_id, array_to_string(outcomes, '|') AS outcomes FROM parsed""")
def question_outcomes(spark, sf):
    return parsed(spark, sf).select("question_id", F.array_join("outcome_any", "|").alias("outcomes"))


@register("question_after_words", covers="Q8", oracle=PARSED_SQL + """
SELECT question_id, array_to_string(agent_words, '|') AS agent_words FROM parsed""")
def question_after_words(spark, sf):
    return parsed(spark, sf).select("question_id", F.array_join("agent_words", "|").alias("agent_words"))


@register("question_amounts", covers="Q9 D24 D25", oracle=PARSED_SQL + """
SELECT question_id, min_amount, max_amount FROM amt""")
def question_amounts(spark, sf):
    return parsed(spark, sf).select("question_id", "min_amount", "max_amount")


# ------------------------------------------------------------------ J3 / J4 / Q10
CATALOG_SQL = """,
catalog AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'agent' AS kind, trim(agent_id) AS value FROM calls_raw
    UNION ALL SELECT 'campaign', trim(campaign) FROM calls_raw
    UNION ALL SELECT 'product', trim(product_name) FROM calls_raw)
  WHERE value IS NOT NULL AND value <> ''),
grounded AS (
  SELECT qq.question_id, c.kind, list_sort(list(DISTINCT c.value)) AS vals
  FROM qq JOIN catalog c
    ON instr(lower(trim(regexp_replace(qq.text, '\\s+', ' ', 'g'))), lower(trim(c.value))) > 0
  GROUP BY 1, 2)"""


def catalog(spark, sf):
    return agg.entity_catalog(fx.calls(spark, sf))


@register("ground_entities", covers="J3 A12", oracle=PARSED_SQL + CATALOG_SQL + """
SELECT question_id, kind, array_to_string(vals, '|') AS vals FROM grounded""")
def ground_entities(spark, sf):
    g = qx.ground_entities(questions(spark, sf), catalog(spark, sf))
    return g.select("question_id", "kind", F.array_join("values", "|").alias("vals"))


def agent_tokens(spark, sf, qs=None, cat=None, parsed_q=None, grounded=None):
    """Per question: sorted distinct (grounded agents ∪ after-words phrases), with positions."""
    qs = qs if qs is not None else questions(spark, sf)
    cat = cat if cat is not None else catalog(spark, sf)
    p = (parsed_q if parsed_q is not None else qx.parse_questions(qs)).select("question_id", "agent_words")
    g = ((grounded if grounded is not None else qx.ground_entities(qs, cat)).filter(F.col("kind") == "agent")
         .select("question_id", F.col("values").alias("ga")))
    toks = p.join(g, "question_id", "left").select(
        "question_id", F.array_sort(F.array_distinct(F.concat(F.coalesce("ga", F.array().cast("array<string>")),
                                                               F.col("agent_words")))).alias("tokens"))
    return toks


TOKENS_SQL = """,
tokens AS (
  SELECT p.question_id,
         list_sort(list_distinct(list_concat(coalesce(g.vals, []::VARCHAR[]), p.agent_words))) AS tokens
  FROM parsed p LEFT JOIN grounded g ON g.question_id = p.question_id AND g.kind = 'agent'),
tok AS (SELECT question_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tokens),
agents_cat AS (SELECT value FROM catalog WHERE kind = 'agent'),
res AS (
  SELECT question_id, pos, value FROM (
    SELECT t.question_id, t.pos, a.value,
           row_number() OVER (PARTITION BY t.question_id, t.pos
                              ORDER BY CASE WHEN lower(trim(a.value)) = lower(trim(t.token)) THEN 0 ELSE 1 END,
                                       a.value) AS rn
    FROM tok t JOIN agents_cat a ON instr(lower(trim(a.value)), lower(trim(t.token))) > 0
    WHERE t.token <> '')
  WHERE rn = 1),
resolved AS (SELECT question_id, list(value ORDER BY pos) AS vals FROM res GROUP BY 1)"""


def resolved_agents(spark, sf, toks=None, cat=None):
    toks = toks if toks is not None else agent_tokens(spark, sf)
    cat = cat if cat is not None else catalog(spark, sf)
    tk = toks.select("question_id", F.posexplode("tokens").alias("pos", "token"))
    return qx.resolve_entities(tk, cat.filter(F.col("kind") == "agent"))


@register("resolve_entities", covers="J4", oracle=PARSED_SQL + CATALOG_SQL + TOKENS_SQL + """
SELECT question_id, array_to_string(list_distinct_ordered, '|') AS resolved FROM (
  SELECT question_id, list_filter(vals, lambda x, i: list_position(vals, x) = i) AS list_distinct_ordered
  FROM resolved)""")
def resolve_entities(spark, sf):
    r = resolved_agents(spark, sf)
    return r.select("question_id", F.array_join("resolved", "|").alias("resolved"))


def specs(spark, sf):
    """One spec row per question (null / empty = no constraint on that key).

    The question table, the entity catalog, the parsed and the grounded questions and their tokens are used by
    several branches (parsing, grounding, resolution); each is computed and written once, in the shared
    scratch folder, instead of being recomputed per branch. Parsing is costly by row, so the questions are
    dealt over all tasks, however few files their tables have."""
    from ..session import staged
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    qs = staged(questions(spark, sf).repartition(tasks), "questions")
    cat = staged(catalog(spark, sf), "entity-catalog")
    p = staged(qx.parse_questions(qs), "parsed-questions")
    g = staged(qx.ground_entities(qs, cat), "grounded-questions")
    gw = (g.groupBy("question_id").pivot("kind", ["agent", "campaign", "product"]).agg(F.first("values")))
    toks = staged(agent_tokens(spark, sf, qs, cat, p, g), "question-tokens")
    res = resolved_agents(spark, sf, toks, cat)
    empty = F.array().cast("array<string>")
    out = (p.join(gw, "question_id", "left").join(toks, "question_id", "left").join(res, "question_id", "left"))
    agents = F.when(F.size(F.coalesce("resolved", empty)) > 0, F.col("resolved")).otherwise(
        F.coalesce("tokens", empty))
    spec = out.select("question_id", "text", "date_from", "date_to", "type_any", "outcome_any",
                      agents.alias("agents"), F.coalesce("campaign", empty).alias("campaigns"),
                      F.coalesce("product", empty).alias("products"), "min_amount", "max_amount",
                      qx.spec_notes(F.col("date_kind"), F.col("date_from"), F.col("date_to"), TZ).alias("notes"))
    return qx.restrict_specs(spec, qx.DEFAULT_ALLOWED_KEYS)


SPECS_SQL = PARSED_SQL + CATALOG_SQL + TOKENS_SQL + """,
specs AS (
  SELECT p.question_id, p.date_from, p.date_to, p.kind,
         CASE WHEN p.type_label IS NULL THEN []::VARCHAR[] ELSE [p.type_label] END AS type_any,
         p.outcomes AS outcome_any,
         CASE WHEN len(coalesce(r.vals, [])) > 0 THEN list_filter(r.vals, lambda x, i: list_position(r.vals, x) = i)
              ELSE coalesce(t.tokens, []::VARCHAR[]) END AS agents,
         coalesce(gc.vals, []::VARCHAR[]) AS campaigns, coalesce(gp.vals, []::VARCHAR[]) AS products,
         a.min_amount, a.max_amount
  FROM parsed p
  LEFT JOIN resolved r ON r.question_id = p.question_id
  LEFT JOIN tokens t ON t.question_id = p.question_id
  LEFT JOIN grounded gc ON gc.question_id = p.question_id AND gc.kind = 'campaign'
  LEFT JOIN grounded gp ON gp.question_id = p.question_id AND gp.kind = 'product'
  LEFT JOIN amt a ON a.question_id = p.question_id)"""


@register("question_specs", covers="Q10 F10", oracle=SPECS_SQL + """
SELECT question_id, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to,
       array_to_string(type_any, '|') AS type_any, array_to_string(outcome_any, '|') AS outcome_any,
       array_to_string(agents, '|') AS agents, array_to_string(campaigns, '|') AS campaigns,
       array_to_string(products, '|') AS products, min_amount, max_amount,
       CASE WHEN date_from IS NULL OR date_to IS NULL THEN '' ELSE
         'Date: ' || CASE kind
           WHEN 'today' THEN 'today' WHEN 'yesterday' THEN 'yesterday' WHEN 'last_n_days' THEN 'last ' || (date_to - date_from) || ' days'
           WHEN 'last_week' THEN 'last week' WHEN 'this_week' THEN 'this week' WHEN 'last_month' THEN 'last month'
           WHEN 'this_month' THEN 'this month' WHEN 'date' THEN CAST(date_from AS VARCHAR)
           ELSE CAST(date_from AS VARCHAR) || '..' || CAST(date_to AS VARCHAR) END || '. Date ' ||
         CASE WHEN date_from = date_to THEN 'resolved to ' || CAST(date_from AS VARCHAR)
              ELSE 'range: ' || CAST(date_from AS VARCHAR) || ' → ' || CAST(date_to AS VARCHAR) END || ' (Europe/Berlin).' END AS notes
FROM specs""")
def question_specs(spark, sf):
    s = specs(spark, sf)
    return s.select("question_id", F.col("date_from").cast("string").alias("date_from"),
                    F.col("date_to").cast("string").alias("date_to"),
                    *[F.array_join(c, "|").alias(c) for c in ("type_any", "outcome_any", "agents", "campaigns",
                                                              "products")],
                    "min_amount", "max_amount", "notes")


# ------------------------------------------------------------------ J9 / A11
def answer_scope(spark, sf, by=(), sp=None):
    """(question_id, *by, n), the size of every question's scope by columns of its calls, evaluated in one pass."""
    return flt.apply_specs(labeled(spark, sf), sp if sp is not None else specs(spark, sf), TZ, by=by)


def _answer_sql_pred() -> str:
    lo = f"timezone('UTC', timezone('{TZ}', CAST(s.date_from AS TIMESTAMP)))"
    hi = f"timezone('UTC', timezone('{TZ}', CAST(s.date_to + 1 AS TIMESTAMP)))"
    return f"""(s.date_from IS NULL OR (c.start_time >= {lo} AND c.start_time < {hi}))
  AND (len(s.type_any) = 0 OR list_contains(list_transform(s.type_any, lambda x: lower(trim(x))), lower(trim(c.Type))))
  AND (len(s.outcome_any) = 0 OR list_contains(list_transform(s.outcome_any, lambda x: lower(trim(x))), lower(trim(c.Outcome))))
  AND (len(s.agents) = 0 OR list_contains(list_transform(s.agents, lambda x: lower(trim(x))), lower(trim(c.agent_id))))
  AND (len(s.campaigns) = 0 OR list_contains(list_transform(s.campaigns, lambda x: lower(trim(x))), lower(trim(c.campaign))))
  AND (len(s.products) = 0 OR len(list_filter(s.products, lambda p: instr(lower(c.product_name), lower(trim(p))) > 0)) > 0)
  AND (s.min_amount IS NULL OR c.amount >= s.min_amount)
  AND (s.max_amount IS NULL OR c.amount <= s.max_amount)"""


def _answer_sql() -> str:
    # LABELED_SQL and SPECS_SQL both start with WITH and share calls_raw; merge the CTE lists.
    lab_ctes = LABELED_SQL.strip()[len("WITH "):]
    spec_body = SPECS_SQL.strip()[len("WITH "):]
    spec_body = spec_body[spec_body.index("qsrc AS"):]          # drop the duplicate calls_raw CTEs
    return "WITH " + lab_ctes + ",\n" + spec_body + f""",
scope AS (SELECT s.question_id, c.call_id, c.Type, c.Outcome FROM specs s JOIN labeled c ON {_answer_sql_pred()})
"""


@register("answer_many", covers="J9 F6", oracle=_answer_sql() + """
SELECT s.question_id, count(sc.call_id) AS n_calls FROM specs s LEFT JOIN scope sc ON sc.question_id = s.question_id
GROUP BY 1""")
def answer_many(spark, sf):
    counts = answer_scope(spark, sf).withColumnRenamed("n", "n_calls")
    qs = questions(spark, sf).select("question_id")
    return qs.join(counts, "question_id", "left").select(
        "question_id", F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"))


@register("scope_tallies", covers="A11 O5", oracle=_answer_sql() + """,
tally AS (
  SELECT question_id, 'type' AS dim, Type AS label, count(*) AS n FROM scope GROUP BY 1, 3
  UNION ALL SELECT question_id, 'outcome', Outcome, count(*) FROM scope GROUP BY 1, 3),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, dim ORDER BY n DESC, label) AS r
                        FROM tally) WHERE r <= 3)
SELECT question_id, dim, string_agg(label || ' (' || n || ')', ', ' ORDER BY r) AS top3,
       (SELECT count(*) FROM scope s2 WHERE s2.question_id = top3.question_id) AS scope_n
FROM top3 GROUP BY question_id, dim""")
def scope_tallies(spark, sf):
    sc = answer_scope(spark, sf, ("Type", "Outcome"))
    return agg.scope_tallies(sc, "question_id", size="n")


SHOWN = 5


@register("answer_sentences", covers="A11 O4", oracle=_answer_sql() + f""",
shown AS (
  SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY question_id ORDER BY call_id) AS n,
                        count(*) OVER (PARTITION BY question_id) AS total FROM scope sc) WHERE n <= {SHOWN}),
tally AS (
  SELECT question_id, 'type' AS dim, Type AS label, count(*) AS n FROM shown GROUP BY 1, 3
  UNION ALL SELECT question_id, 'outcome', Outcome, count(*) FROM shown GROUP BY 1, 3),
top3 AS (SELECT question_id, dim, string_agg(label || ' (' || n || ')', ', ' ORDER BY n DESC, label) AS txt
         FROM (SELECT *, row_number() OVER (PARTITION BY question_id, dim ORDER BY n DESC, label) AS r FROM tally) WHERE r <= 3 GROUP BY 1, 2),
tot AS (SELECT question_id, any_value(total) AS total, count(*) AS shown FROM shown GROUP BY 1)
SELECT s.question_id,
       CASE WHEN coalesce(tot.shown, 0) < coalesce(tot.total, 0) THEN 'Showing top ' || tot.shown || ' of ' || tot.total || ' calls.'
            ELSE coalesce(tot.total, 0) || ' calls in scope.' END
       || CASE WHEN s.date_from IS NULL OR s.date_to IS NULL THEN ''
               ELSE ' Date range: ' || CAST(s.date_from AS VARCHAR) || ' → ' || CAST(s.date_to AS VARCHAR) || '.' END
       || coalesce(' Top types: ' || t.txt || '.', '') || coalesce(' Top outcomes: ' || o.txt || '.', '') AS answer
FROM specs s LEFT JOIN tot ON tot.question_id = s.question_id
LEFT JOIN top3 t ON t.question_id = s.question_id AND t.dim = 'type'
LEFT JOIN top3 o ON o.question_id = s.question_id AND o.dim = 'outcome'""")
def answer_sentences(spark, sf):
    from ..session import staged
    sp = staged(specs(spark, sf), "question-specs")
    calls = staged(labeled(spark, sf).drop("transcript"), "labeled")       # the sizes and the shown calls read them
    sizes = flt.apply_specs(calls, sp, TZ, by=())
    scope = flt.apply_specs(calls, sp, TZ, by=("Type", "Outcome"), first=SHOWN)
    return agg.answer_sentences(scope, sp, shown=SHOWN, sizes=sizes)
