"""Question text -> filter spec, as Column expressions over a table of questions.

Every question row (``question_id``, ``text``, ``as_of`` date) is parsed in one
narrow projection: dates (explicit, ranges, relative to ``as_of``, month
windows), an exclusive call type, outcomes, agent phrases and amount bounds.
Entity grounding against the catalog is an exact substring test by automata over
blocks of catalog values (``patterns``; no cartesian product).
"""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .patterns import substring_pairs

# --- fixed values: month names, type / outcome patterns, synonyms (must equal the reference) ---
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4,
    "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
RANGE_HINTS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov",
               "dec", "202")
TYPE_CANONICAL = ("Billing/Sales", "Support", "Inquiry", "Complaint")
OUTCOME_CANONICAL = ("Unknown", "Resolved", "Callback", "Refund", "Sale-close", "Disconnected")
TYPE_PATTERNS = [
    (r"\b(inquiry|queries|general inquiry)\b", "Inquiry"),
    (r"\b(sales|billing|sales[- ]related)\b", "Billing/Sales"),
    (r"\b(support|technical support|tech support)\b", "Support"),
    (r"\b(complaint|escalation|issue)\b", "Complaint"),
    (r"\b(inquiry|sales|billing|support|complaint)[- ]related\b", None),
    (r"related to (inquiry|sales|billing|support|complaint)\b", None),
    (r"\btype\s+(inquiry|sales|billing|support|complaint)\b", None),
]
TYPE_WORDS = {"inquiry": "Inquiry", "queries": "Inquiry", "sales": "Billing/Sales",
              "billing": "Billing/Sales", "support": "Support", "complaint": "Complaint"}
OUTCOME_PATTERNS = [
    (r"\bunknown\b", "Unknown"),
    (r"\bresolved|fixed|solved\b", "Resolved"),
    (r"\bcallback|call back\b", "Callback"),
    (r"\brefund|refunded\b", "Refund"),
    (r"\bsale[- ]close|purchase completed\b", "Sale-close"),
    (r"\bdisconnected|dropped|hang ?up|hung up\b", "Disconnected"),
    (r"outcome\s+is\s+([A-Za-z\- ]+)", None),
]
SYNONYMS = [
    ("sales", {"type_any": ["Billing/Sales"]}),
    ("sales-related", {"type_any": ["Billing/Sales"]}),
    ("billing", {"type_any": ["Billing/Sales"]}),
    ("sales calls", {"type_any": ["Billing/Sales"]}),
    ("support", {"type_any": ["Support"]}),
    ("support calls", {"type_any": ["Support"]}),
    ("technical support", {"type_any": ["Support"]}),
    ("inquiry", {"type_any": ["Inquiry"]}),
    ("inquiries", {"type_any": ["Inquiry"]}),
    ("complaint", {"type_any": ["Complaint"]}),
    ("complaints", {"type_any": ["Complaint"]}),
    ("unknown", {"outcome_any": ["Unknown"]}),
    ("unknown outcome", {"outcome_any": ["Unknown"]}),
    ("resolved", {"outcome_any": ["Resolved"]}),
    ("callback", {"outcome_any": ["Callback"]}),
    ("refund", {"outcome_any": ["Refund"]}),
    ("sale-close", {"outcome_any": ["Sale-close"]}),
    ("disconnected", {"outcome_any": ["Disconnected", "Dropped", "Hangup"]}),
    ("disconnect", {"outcome_any": ["Disconnected", "Dropped", "Hangup"]}),
    ("dropped", {"outcome_any": ["Disconnected", "Dropped", "Hangup"]}),
    ("dropped call", {"outcome_any": ["Disconnected", "Dropped", "Hangup"]}),
    ("hang up", {"outcome_any": ["Disconnected", "Dropped", "Hangup"]}),
    ("hangup", {"outcome_any": ["Disconnected", "Dropped", "Hangup"]}),
]
AFTER_WORDS = ("by", "agent", "rep")
AFTER_MAX_TOKENS = 3
ISO_RE = r"\b(20\d{2})-(\d{1,2})-(\d{1,2})\b"
DMY_RE = r"\b(\d{1,2})[./](\d{1,2})[./](20\d{2})\b"
D_MON_Y_RE = r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s+(20\d{2})\b"
MON_D_Y_RE = r"\b([A-Za-z]{3,9})\s+(\d{1,2})\s+(20\d{2})\b"
MON_Y_RE = r"\b([A-Za-z]{3,9})\s+(20\d{2})\b"
NUM = r"(\d+(?:[\.,]\d+)?)"
# --- end fixed values ---

MONTH_ONLY_RE = r"\b(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\b"


def _month_map() -> Column:
    items = []
    for k, v in MONTHS.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _valid_date(y: Column, m: Column, d: Column) -> Column:
    """make_date that yields null (never an error) on impossible dates, ANSI mode or not."""
    month_ok = (m >= 1) & (m <= 12) & (d >= 1)
    return F.when(month_ok, F.when(d <= F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1)))),
                                   F.make_date(y, m, d)))


def _grp(s: Column, pat: str, i: int) -> Column:
    v = F.regexp_extract(s, pat, i)
    return F.when(v != "", v)


def first_date(fragment: Column) -> Column:
    """Q1: first explicit date in a fragment (ISO, D/M/Y, '13 Aug 2025', 'Aug 13 2025')."""
    return _first_date(_date_text(fragment))


def _date_text(fragment: Column) -> Column:
    return tx.unicode_trim(F.regexp_replace(fragment, ",", " "))


def _first_date(s: Column) -> Column:
    mm = _month_map()
    iso = _valid_date(_grp(s, ISO_RE, 1).cast("int"), _grp(s, ISO_RE, 2).cast("int"),
                      _grp(s, ISO_RE, 3).cast("int"))
    a = _grp(s, DMY_RE, 1).cast("int")
    b = _grp(s, DMY_RE, 2).cast("int")
    y = _grp(s, DMY_RE, 3).cast("int")
    day = F.when((a <= 12) & (b <= 12), a).when(a <= 12, b).otherwise(a)
    mon = F.when((a <= 12) & (b <= 12), b).when(a <= 12, a).otherwise(b)
    dmy = _valid_date(y, mon, day)
    m3 = mm[F.lower(_grp(s, D_MON_Y_RE, 2))]
    dmy_word = _valid_date(_grp(s, D_MON_Y_RE, 3).cast("int"), m3, _grp(s, D_MON_Y_RE, 1).cast("int"))
    m4 = mm[F.lower(_grp(s, MON_D_Y_RE, 1))]
    mdy_word = _valid_date(_grp(s, MON_D_Y_RE, 3).cast("int"), m4, _grp(s, MON_D_Y_RE, 2).cast("int"))
    # a pattern that matches decides (even if its date is invalid), like the reference
    return (F.when(_grp(s, ISO_RE, 0).isNotNull(), iso)
             .when(_grp(s, DMY_RE, 0).isNotNull(), dmy)
             .when(_grp(s, D_MON_Y_RE, 0).isNotNull() & m3.isNotNull(), dmy_word)
             .when(_grp(s, MON_D_Y_RE, 0).isNotNull() & m4.isNotNull(), mdy_word))


def has_explicit_date(s: Column) -> Column:
    return s.rlike(ISO_RE) | s.rlike(DMY_RE) | s.rlike(D_MON_Y_RE) | s.rlike(MON_D_Y_RE)


RANGE_PATTERNS = (r"between\s+(.*?)\s+and\s+(.*)", r"from\s+(.*?)\s+to\s+(.*)",
                  r"(.*?)\s+-\s+(.*)")                      # D27: spaces around the range hyphen
#: what a text must hold for a range pattern to be found: the last one alone would be tried from every place to the text's end
RANGE_SIGNS = (RANGE_PATTERNS[0], RANGE_PATTERNS[1], r"\s-\s")
YEAR_RE = r"20\d{2}"                                         # in every explicit date


def date_candidates(s: Column) -> Column:
    """First explicit date of each range side and of the whole text, as one array.

    ``first_date`` is written once inside a higher-order function instead of seven
    times inline: the generated code stays small (no 64 KB codegen fallback and no
    long compile) and each fragment is cleaned and parsed once, and only if the text has the year of
    an explicit date (null without one)."""
    frags = []
    for pat, sign in zip(RANGE_PATTERNS, RANGE_SIGNS):
        frags += [F.when(s.rlike(sign), F.regexp_extract(s, pat, i)).otherwise("") for i in (1, 2)]
    frags.append(s)
    cleaned = F.transform(F.array(*frags), _date_text)
    return F.when(s.rlike(YEAR_RE), F.transform(cleaned, lambda f: F.when(f.rlike(YEAR_RE), _first_date(f))))


def parse_dates_from(s: Column, dts: Column, as_of: Column) -> Column:
    """Q1–Q4: struct(date_from, date_to, kind) by priority: explicit ranges, single date,
    relative (today / yesterday / last N days), week and month windows, month-year,
    month-only (year of ``as_of``). ``s`` is the lower-cased text, ``dts`` its
    ``date_candidates``."""
    hint = F.lit(False)
    for h in RANGE_HINTS:
        hint = hint | (F.instr(s, h) > 0)
    ranges = []
    for i, sign in enumerate(RANGE_SIGNS):
        d1, d2 = dts[2 * i], dts[2 * i + 1]
        ok = d1.isNotNull() & d2.isNotNull() & s.rlike(sign)
        if i == 2:
            ok = ok & hint
        ranges.append((ok, F.least(d1, d2), F.greatest(d1, d2)))
    single = dts[6]
    n_days = F.regexp_extract(s, r"(last|past)\s+(\d{1,3})\s+days?", 2)
    wd = F.dayofweek(as_of)                                  # Sunday=1 .. Saturday=7
    monday_off = (wd + 5) % 7                                # days since Monday
    last_week_end = F.date_sub(as_of, monday_off + 1)
    this_week_start = F.date_sub(as_of, monday_off)
    first_this = F.trunc(as_of, "month")
    last_prev = F.date_sub(first_this, 1)
    my_word = F.lower(_grp(s, MON_Y_RE, 1))
    my_mon = _month_map()[my_word]
    my_year = _grp(s, MON_Y_RE, 2).cast("int")
    no_explicit = ~has_explicit_date(s)
    mo_word = _grp(s, MONTH_ONLY_RE, 1)
    mo_mon = _month_map()[mo_word]

    def rng(a, b, note):
        return F.struct(a.cast("date").alias("date_from"), b.cast("date").alias("date_to"),
                        F.lit(note).alias("kind"))

    my_start = F.make_date(my_year, my_mon, F.lit(1))
    mo_start = F.make_date(F.year(as_of), mo_mon, F.lit(1))
    none = F.struct(F.lit(None).cast("date").alias("date_from"), F.lit(None).cast("date").alias("date_to"),
                    F.lit(None).cast("string").alias("kind"))
    out = F.when(ranges[0][0], rng(ranges[0][1], ranges[0][2], "range"))
    for ok, a, b in ranges[1:]:
        out = out.when(ok, rng(a, b, "range"))
    return (out.when(single.isNotNull(), rng(single, single, "date"))
               .when(F.instr(s, "today") > 0, rng(as_of, as_of, "today"))
               .when(F.instr(s, "yesterday") > 0, rng(F.date_sub(as_of, 1), F.date_sub(as_of, 1), "yesterday"))
               .when(n_days != "", rng(F.date_sub(as_of, n_days.cast("int")), as_of, "last_n_days"))
               .when(F.instr(s, "last week") > 0, rng(F.date_sub(last_week_end, 6), last_week_end, "last_week"))
               .when(F.instr(s, "this week") > 0,
                     rng(this_week_start, F.least(F.date_add(this_week_start, 6), as_of), "this_week"))
               .when(F.instr(s, "last month") > 0, rng(F.trunc(last_prev, "month"), last_prev, "last_month"))
               .when(F.instr(s, "this month") > 0, rng(first_this, as_of, "this_month"))
               .when(my_mon.isNotNull() & no_explicit, rng(my_start, F.last_day(my_start), "month_year"))
               .when(mo_mon.isNotNull() & no_explicit, rng(mo_start, F.last_day(mo_start), "month"))
               .otherwise(none))


# --- fixed values: parse notes by kind of date ---
DATE_NOTES = {"range": "Date: {from}..{to}.", "date": "Date: {from}.", "today": "Date: today.", "yesterday": "Date: yesterday.",
              "last_n_days": "Date: last {n} days.", "last_week": "Date: last week.", "this_week": "Date: this week.",
              "last_month": "Date: last month.", "this_month": "Date: this month.", "month_year": "Date: {from}..{to}.",
              "month": "Date: {from}..{to}."}
RESOLVED_NOTES = {"one": "Date resolved to {from} ({tz}).", "two": "Date range: {from} → {to} ({tz})."}
# --- end fixed values ---


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """A template's text with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def spec_notes(kind: Column, date_from: Column, date_to: Column, tz: str) -> Column:
    """Q10: the parse trace of a question's dates; empty without dates."""
    days = F.date_diff(date_to, date_from).cast("string")
    values = {"from": date_from.cast("string"), "to": date_to.cast("string"), "n": days, "tz": F.lit(tz)}
    found = F.coalesce(*[F.when(kind == k, filled(t, values)) for k, t in DATE_NOTES.items()])
    resolved = F.when(date_from == date_to, filled(RESOLVED_NOTES["one"], values)).otherwise(filled(RESOLVED_NOTES["two"], values))
    return F.when(date_from.isNotNull() & date_to.isNotNull(), F.concat_ws(" ", found, resolved)).otherwise(F.lit(""))


def _first_synonym(s: Column, key: str, canonical: Sequence[str]) -> Column:
    out = None
    for phrase, mapping in SYNONYMS:
        vals = [v for v in mapping.get(key, []) if v in canonical]
        if not vals:
            continue
        cond = F.instr(s, phrase.lower()) > 0
        out = F.when(cond, F.lit(vals[0])) if out is None else out.when(cond, F.lit(vals[0]))
    return out if out is not None else F.lit(None).cast("string")


def detect_type(text: Column) -> Column:
    """Q5: one exclusive type: earliest pattern hit (pattern order on ties), else first synonym."""
    s = F.lower(text)
    hits = []
    for i, (pat, label) in enumerate(TYPE_PATTERNS):
        pos = F.regexp_instr(s, F.lit(pat))
        if label is not None:
            lab = F.lit(label)
        else:
            word = F.regexp_extract(s, pat, 1)
            lab = None
            for w, l in TYPE_WORDS.items():
                lab = F.when(word == w, F.lit(l)) if lab is None else lab.when(word == w, F.lit(l))
        hits.append(F.when((pos > 0) & lab.isNotNull(),
                           F.struct(pos.alias("pos"), F.lit(i).alias("ord"), lab.alias("label"))))
    best = F.array_min(F.array_compact(F.array(*hits)))
    return F.coalesce(best["label"], _first_synonym(s, "type_any", TYPE_CANONICAL))


def title_case(c: Column) -> Column:
    """Python ``str.title`` for ASCII: upper after a non-letter, lower elsewhere."""
    chars = F.split(c, "")
    out = F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.coalesce(F.element_at(chars, F.greatest(i, F.lit(1))).rlike("^[A-Za-z]$"), F.lit(False)),
        F.upper(ch)).otherwise(F.lower(ch)))
    return F.array_join(out, "")


def detect_outcomes(text: Column) -> Column:
    """Q6/Q7/U4: outcome labels in pattern order (+ explicit 'outcome is X' title-cased),
    synonym targets appended, de-duplicated; canonical labels only if any is present."""
    s = F.lower(text)
    items = []
    for pat, label in OUTCOME_PATTERNS:
        if label is not None:
            items.append(F.array(F.when(s.rlike(pat), F.lit(label))))
        else:
            grp = F.regexp_extract(s, pat, 1)
            items.append(F.array(F.when(s.rlike(pat), title_case(tx.unicode_trim(grp)))))
    for phrase, mapping in SYNONYMS:
        vals = mapping.get("outcome_any", [])
        if vals:
            items.append(F.when(F.instr(s, phrase.lower()) > 0,
                                F.array(*[F.lit(v) for v in vals])).otherwise(F.array().cast("array<string>")))
    allv = F.array_distinct(F.array_compact(F.flatten(F.array(*items))))
    canon = F.filter(allv, lambda x: x.isin(list(OUTCOME_CANONICAL)))
    return F.when(F.size(canon) > 0, canon).otherwise(allv)


def after_words(text: Column, words: Sequence[str] = AFTER_WORDS, max_tokens: int = AFTER_MAX_TOKENS) -> Column:
    """Q8: up to ``max_tokens`` tokens after 'by' / 'agent' / 'rep' (word order, then match order)."""
    s = F.concat(F.lit(" "), tx.unicode_trim(text), F.lit(" "))
    parts = []
    for w in words:
        pat = r"(?i)\b" + w + r"\s+([A-Za-z0-9][A-Za-z0-9_\- ]{0,64})"
        frags = F.regexp_extract_all(s, F.lit(pat), 1)
        parts.append(F.transform(frags, lambda f: F.array_join(
            F.slice(F.filter(F.split(f, r"\s+"), lambda t: t != ""), 1, max_tokens), " ")))
    return F.filter(F.flatten(F.array(*parts)), lambda x: x != "")


def _num(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".").cast("double")


def strip_dates(s: Column) -> Column:
    """Remove explicit dates so '2025-08-13' is not read as an amount range."""
    for pat in (ISO_RE, DMY_RE, D_MON_Y_RE, MON_D_Y_RE):
        s = F.regexp_replace(s, pat, " ")
    return s


def parse_amounts(text: Column) -> Column:
    """Q9: struct(min_amount, max_amount) from 'A-B', 'between A and B', 'from $A to $B' (D25),
    '>=', '<=' / '≤', 'min N', 'max N'; decimal comma accepted."""
    s = strip_dates(F.regexp_replace(F.regexp_replace(F.lower(text), "–", "-"), "—", "-"))
    p1 = r"\$?\s*" + NUM + r"\s*-\s*\$?\s*" + NUM
    p2 = r"between\s+" + NUM + r"\s+and\s+" + NUM
    p3 = r"from\s+\$?\s*" + NUM + r"\s+to\s+\$?\s*" + NUM
    lo = F.lit(None).cast("double")
    hi = F.lit(None).cast("double")
    ge = _grp(s, r">=\s*" + NUM, 1)
    le = _grp(s, r"(?:<=|≤)\s*" + NUM, 1)
    mn = _grp(s, r"\bmin\s*" + NUM, 1)
    mx = _grp(s, r"\bmax\s*" + NUM, 1)
    lo = F.coalesce(_num(mn), _num(ge))
    hi = F.coalesce(_num(mx), _num(le))
    out_lo, out_hi = lo, hi
    for p in (p3, p2, p1):                        # later assignment = higher priority
        a = _num(_grp(s, p, 1))
        b = _num(_grp(s, p, 2))
        hit = s.rlike(p)
        out_lo = F.when(hit, F.least(a, b)).otherwise(out_lo)
        out_hi = F.when(hit, F.greatest(a, b)).otherwise(out_hi)
    return F.struct(out_lo.alias("min_amount"), out_hi.alias("max_amount"))


def parse_questions(questions: DataFrame, text_col: str = "text", as_of_col: str = "as_of") -> DataFrame:
    """Q1–Q9: adds date_from, date_to, date_kind, type_any, outcome_any, agent_words, min_amount,
    max_amount. Computed in stages (lower-cased text, then date candidates, then the
    decisions) so each regular expression runs once per row."""
    base = questions.select("*", F.lower(F.col(text_col)).alias("_s"))
    base = base.select("*", date_candidates(F.col("_s")).alias("_dts"))
    dates = parse_dates_from(F.col("_s"), F.col("_dts"), F.col(as_of_col))
    t = F.col(text_col)
    amounts = parse_amounts(t)
    typ = detect_type(t)
    out = base.select(
        "*",
        dates.alias("_d"),
        F.when(typ.isNotNull(), F.array(typ)).otherwise(F.array().cast("array<string>")).alias("type_any"),
        detect_outcomes(t).alias("outcome_any"),
        after_words(t).alias("agent_words"),
        amounts.alias("_a"))
    return out.select(*[c for c in questions.columns],
                      F.col("_d.date_from").alias("date_from"), F.col("_d.date_to").alias("date_to"),
                      F.col("_d.kind").alias("date_kind"), "type_any", "outcome_any", "agent_words",
                      F.col("_a.min_amount").alias("min_amount"), F.col("_a.max_amount").alias("max_amount"))


# ----------------------------------------------------------------- J3 / J4
def _norm_text(c: Column) -> Column:
    return F.lower(tx.unicode_trim(F.regexp_replace(c, f"{tx.WS_CLASS}+", " ")))


def ground_entities(questions: DataFrame, catalog: DataFrame, id_col: str = "question_id",
                    text_col: str = "text") -> DataFrame:
    """Per question and kind, the sorted distinct catalog values whose normalized form occurs
    in the normalized question. Returns (question_id, kind, values array<string>)."""
    qn = questions.select(F.col(id_col).alias("_qid"), _norm_text(F.col(text_col)).alias("_qn"))
    cn = catalog.select("kind", "value", _norm_text(F.col("value")).alias("_vn"))
    hits = substring_pairs(qn, "_qn", cn, "_vn")
    return (hits.groupBy("_qid", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
                .withColumnRenamed("_qid", id_col))


def resolve_entities(tokens: DataFrame, catalog: DataFrame, id_col: str = "question_id") -> DataFrame:
    """Each (question, pos, token) -> equal catalog value if any, else the first (sorted)
    catalog value containing the token; de-duplicated per question in token order.
    ``tokens`` has (question_id, pos, token); returns (question_id, resolved array<string>)."""
    tk = tokens.select(F.col(id_col).alias("_qid"), "pos", "token", _norm_text(F.col("token")).alias("_tn"))
    cn = catalog.select("value", _norm_text(F.col("value")).alias("_vn"))
    pairs = substring_pairs(cn, "_vn", tk, "_tn")
    w = Window.partitionBy("_qid", "pos").orderBy(F.when(F.col("_vn") == F.col("_tn"), 0).otherwise(1),
                                                  F.col("value"))
    best = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    per_q = best.groupBy("_qid").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_s"))
    return per_q.select(F.col("_qid").alias(id_col),
                        F.array_distinct(F.transform("_s", lambda x: x["value"])).alias("resolved"))


# ----------------------------------------------------------------- F10
DEFAULT_ALLOWED_KEYS = ("date_from", "date_to", "type_any", "outcome_any", "agents", "campaigns",
                        "products", "min_amount", "max_amount")


def restrict_specs(specs: DataFrame, allowed: Sequence[str] = DEFAULT_ALLOWED_KEYS) -> DataFrame:
    """keep only whitelisted spec keys (dates always survive); a removed list key becomes an
    empty list and a removed bound becomes null, i.e. 'no constraint'."""
    keep = set(allowed) | {"date_from", "date_to"}
    out = specs
    for c in ("type_any", "outcome_any", "agents", "campaigns", "products"):
        if c in specs.columns and c not in keep:
            out = out.withColumn(c, F.array().cast("array<string>"))
    for c in ("min_amount", "max_amount"):
        if c in specs.columns and c not in keep:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out
