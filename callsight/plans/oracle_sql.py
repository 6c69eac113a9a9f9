"""DuckDB SQL building blocks for the correctness oracle.

The oracle is an independent statement of each query's semantics in plain SQL,
run by DuckDB on the same parquet tables. Helpers here only format SQL text
(literals, the derived ``calls`` CTE, the label CTE); they do not share code
with the Spark expressions.
"""

from __future__ import annotations

from ..functions.text import NEGATION_WORDS, TOKEN_PATTERN
from ..operators.labels import RuleSet

NOT_WORD = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + str(s).replace("'", "''") + "'"


def neg_re(words=NEGATION_WORDS) -> str:
    return f"(^|{NOT_WORD})({'|'.join(words)})({NOT_WORD}|$)"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(coalesce({expr}, ''), {q(TOKEN_PATTERN)})"


def guard(t: str, phrase: str, words=NEGATION_WORDS) -> str:
    p = q(phrase.lower())
    pos = f"instr({t}, {p})"
    st = f"greatest(1, {pos} - 20)"
    return (f"({pos} > 0 AND NOT coalesce(regexp_matches(substring({t}, {st}, {pos} - {st}), "
            f"{q(neg_re(words))}), false))")


def any_in(t: str, phrases) -> str:
    parts = [f"instr({t}, {q(str(p).lower())}) > 0" for p in phrases if str(p).strip()]
    return "(" + (" OR ".join(parts) if parts else "false") + ")"


def fmt_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def raw_label(one: str, other: str) -> str:
    return (f"CASE d.doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN {q(one)} WHEN 2 THEN 'unknown' "
            f"WHEN 3 THEN '' WHEN 4 THEN 'bogus' ELSE {q(other)} END")


FIRST_LINE_CTE = """first_li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity,
           row_number() OVER (PARTITION BY l_orderkey
                              ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn
    FROM lineitem) WHERE rn = 1)"""

CALLS_RAW_CTE = FIRST_LINE_CTE + """,
calls_raw AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS call_id,
         CASE WHEN d.doc_id % 97 = 0 THEN NULL
              ELSE o.o_orderdate + to_seconds((d.doc_id * 7919) % 86400) END AS start_time,
         CASE WHEN d.doc_id % 50 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) / 20.0 END
           AS duration_seconds,
         d.text AS transcript,
         CASE WHEN fl.l_suppkey IS NULL THEN NULL
              ELSE 'A' || lpad(CAST(fl.l_suppkey % 20 AS VARCHAR), 3, '0') END AS agent_id,
         c.c_mktsegment AS campaign,
         c.c_name AS customer_name,
         p.p_name AS product_name,
         CAST(fl.l_quantity AS BIGINT) AS quantity,
         o.o_totalprice AS amount,
         CAST(o.o_orderkey AS VARCHAR) AS order_id,
         """ + raw_label("Connected", "Disconnected") + """ AS raw_connected,
         """ + raw_label("Support", "Complaint") + """ AS raw_type,
         """ + raw_label("Refund", "Resolved") + """ AS raw_outcome
  FROM documents d
  JOIN orders o ON o.o_orderkey = d.doc_id
  JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN first_li fl ON fl.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = fl.l_partkey)"""


def label_ctes(rules: RuleSet, source: str = "calls_raw", words=NEGATION_WORDS,
               name: str = "labeled") -> str:
    """CTEs computing Connected/Type/Outcome from ``source`` (must have transcript, duration)."""
    feats = f"""{name}_f AS (
  SELECT *, lower(coalesce(transcript, '')) AS lc,
         {tokens('transcript')} AS toks
  FROM {source}),
{name}_g AS (
  SELECT *, len(toks) AS ntok,
         lower(array_to_string(list_slice(toks, CAST(floor(len(toks) * {1.0 - rules.outcome_window_frac!r}) AS BIGINT) + 1,
                                          len(toks)), ' ')) AS tl
  FROM {name}_f)"""
    scores = []
    for i, (label, phrases) in enumerate(rules.types):
        terms = [f"(CASE WHEN {guard('lc', p, words)} THEN 1 ELSE 0 END)" for p in phrases if str(p).strip()]
        scores.append(f"({' + '.join(terms) if terms else '0'}) AS s{i}")
    idx = {label: i for i, (label, _) in enumerate(rules.types)}
    mx = "greatest(" + ", ".join(f"s{i}" for i in range(len(rules.types))) + ")"
    type_case = "CASE WHEN mx <= 0 THEN 'Unknown' " + " ".join(
        f"WHEN s{idx[lab]} = mx THEN {q(lab)}" for lab in rules.type_order()) + " END"
    blocked = any_in("tl", rules.refund_negations)
    out_terms = []
    for label in rules.outcome_priority:
        phrases = [p for p in rules.outcome_phrases(label) if str(p).strip()]
        if not phrases:
            continue
        hit = "(" + " OR ".join(guard("tl", p, words) for p in phrases) + ")"
        if label == "Refund":
            hit = f"({hit} AND NOT {blocked})"
        out_terms.append(f"WHEN {hit} THEN {q(label)}")
    outcome_case = "CASE " + " ".join(out_terms) + " ELSE 'Unknown' END"
    dur = "coalesce(CAST(duration_seconds AS DOUBLE), 0.0)"
    cue = any_in("lc", rules.disconnection_cues)
    connected = (f"CASE WHEN NOT isnan({dur}) AND {dur} >= {float(rules.short_disconnected_s)} "
                 f"AND NOT {cue} AND {dur} >= {float(rules.duration_cutoff_s)} "
                 f"AND ntok >= {int(rules.min_tokens)} THEN 'Connected' ELSE 'Disconnected' END")
    return feats + f""",
{name}_s AS (
  SELECT *, {', '.join(scores)} FROM {name}_g),
{name}_m AS (SELECT *, {mx} AS mx FROM {name}_s),
{name} AS (
  SELECT * EXCLUDE (lc, toks, ntok, tl, mx, {', '.join(f's{i}' for i in range(len(rules.types)))}),
         {connected} AS Connected,
         {type_case} AS Type,
         {outcome_case} AS Outcome
  FROM {name}_m)"""


def gate_ctes(source: str = "calls_raw", min_tokens: int = 20) -> str:
    return f"""gated AS (
  SELECT * FROM {source} WHERE len({tokens('transcript')}) >= {int(min_tokens)})"""


def labeled_calls_sql(rules: RuleSet, words=NEGATION_WORDS) -> str:
    """WITH-prefix defining ``calls_raw``, ``gated`` and ``labeled`` (rules applied to gated)."""
    return ("WITH " + CALLS_RAW_CTE + ",\n" + gate_ctes() + ",\n"
            + label_ctes(rules, source="gated", words=words) + "\n")
