"""Rule-based call labeling (Connected / Type / Outcome) as Column expressions.

A :class:`RuleSet` is an immutable description of the phrase rules. It is
compiled on the driver into plain Column expressions (``instr``/``substring``/
``rlike``), so labeling a billion transcripts is one narrow projection with no
shuffle and no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import UNKNOWN
from .patterns import first_places


@dataclass(frozen=True)
class RuleSet:
    duration_cutoff_s: int = 30
    min_tokens: int = 40
    short_disconnected_s: int = 10
    disconnection_cues: tuple = ()
    types: tuple = ()                 # ((label, (phrase, ...)), ...) in configured order
    type_tie_break: tuple = ("Complaint", "Support", "Billing/Sales", "Inquiry")
    outcomes: tuple = ()              # ((label, (phrase, ...)), ...)
    refund_negations: tuple = ()
    outcome_window_frac: float = 0.25
    outcome_priority: tuple = ("Refund", "Sale-close", "Callback", "Resolved")
    explain_outcome_order: tuple = ("Resolved", "Callback", "Refund", "Sale-close")
    negation_words: tuple = tuple(tx.NEGATION_WORDS)

    @staticmethod
    def from_mapping(cfg: Mapping) -> "RuleSet":
        """Build from the nested mapping layout of a rules YAML file."""
        con = dict(cfg.get("connected") or {})
        outs = dict(cfg.get("outcomes") or {})
        negs = tuple(outs.pop("negations", []) or [])
        return RuleSet(
            duration_cutoff_s=int(con.get("duration_cutoff_s", 30)),
            min_tokens=int(con.get("min_tokens", 40)),
            short_disconnected_s=int(con.get("short_disconnected_s", 10)),
            disconnection_cues=tuple(con.get("disconnection_cues", []) or []),
            types=tuple((k, tuple(v or [])) for k, v in (cfg.get("types") or {}).items()),
            type_tie_break=tuple(cfg.get("type_tie_break",
                                         ["Complaint", "Support", "Billing/Sales", "Inquiry"])),
            outcomes=tuple((k, tuple(v or [])) for k, v in outs.items()),
            refund_negations=negs,
            outcome_window_frac=float(cfg.get("outcome_window_frac", 0.25) or 0.25),
        )

    def with_cutoff(self, cutoff: int | None) -> "RuleSet":
        return self if cutoff is None else replace(self, duration_cutoff_s=int(cutoff))

    def outcome_phrases(self, label: str) -> tuple:
        return dict(self.outcomes).get(label, ())

    def type_order(self) -> list[str]:
        """Labels in tie-break order; labels not named there follow alphabetically."""
        names = [k for k, _ in self.types]
        head = [t for t in self.type_tie_break if t in names]
        return head + sorted(n for n in names if n not in head)


# --- fixed values: the shipped default rule set ---
DEFAULT_RULES = RuleSet(
    duration_cutoff_s=30, min_tokens=40, short_disconnected_s=10,
    disconnection_cues=("voicemail", "leave a message", "the number you have dialed", "hello?"),
    types=(
        ("Inquiry", ("information", "status", "want to know", "question about", "how to",
                     "where can I", "clarify", "explain", "details")),
        ("Billing/Sales", ("bill", "invoice", "charge", "overcharge", "payment", "price", "quote",
                           "order", "plan", "upgrade", "subscription", "discount", "receipt")),
        ("Support", ("not working", "issue", "error", "bug", "fail", "failed", "cannot", "can't",
                     "troubleshoot", "reset", "configure", "down", "broken", "outage", "fix")),
        ("Complaint", ("complaint", "poor service", "unhappy", "frustrated", "speak to a manager",
                       "escalate", "escalation", "cancel service", "unacceptable", "bad experience")),
    ),
    type_tie_break=("Complaint", "Support", "Billing/Sales", "Inquiry"),
    outcomes=(
        ("Resolved", ("glad we could fix", "should work now", "close the ticket", "close the case",
                      "issue is resolved", "we've sorted it", "anything else I can help")),
        ("Callback", ("we will call you back", "schedule a callback", "reach out tomorrow",
                      "ring you back", "follow up")),
        ("Refund", ("issued a refund", "processed the refund", "reversal posted",
                    "refund will reflect", "credited your account")),
        ("Sale-close", ("order placed", "subscription activated", "payment processed",
                        "welcome aboard", "upgraded your plan", "purchase confirmed")),
    ),
    refund_negations=("refund denied", "no refund", "not eligible for refund", "refund not approved"),
    outcome_window_frac=0.25,
)
# --- end fixed values ---


def _nonblank(phrases) -> list[str]:
    return [str(p) for p in phrases if str(p).strip() != "" and str(p) != ""]


def connected_expr(duration: Column, text_lc: Column, n_tokens: Column, rules: RuleSet) -> Column:
    """L1: Connected iff duration >= short and >= cutoff, tokens >= min, and no cue.
    Null duration counts as 0; NaN compares false everywhere (as in Python)."""
    d = F.coalesce(duration.cast("double"), F.lit(0.0))
    finite = ~F.isnan(d)
    cue = tx.contains_any(text_lc, rules.disconnection_cues)
    ok = (finite & (d >= float(rules.short_disconnected_s)) & ~cue
          & (d >= float(rules.duration_cutoff_s)) & (n_tokens >= int(rules.min_tokens)))
    return F.when(ok, F.lit("Connected")).otherwise(F.lit("Disconnected"))


def bucket_score(text_lc: Column, phrases, rules: RuleSet) -> Column:
    """L2: number of keywords present without a nearby negation (one point per keyword)."""
    score = F.lit(0)
    for kw in _nonblank(phrases):
        score = score + F.when(tx.negation_guard(text_lc, kw, rules.negation_words), 1).otherwise(0)
    return score


def type_from_scores(scores: Mapping[str, Column], rules: RuleSet) -> Column:
    """L3 decision over per-bucket score columns."""
    if not scores:
        return F.lit(UNKNOWN)
    mx = F.greatest(*scores.values()) if len(scores) > 1 else list(scores.values())[0]
    out = None
    for label in rules.type_order():
        cond = scores[label] == mx
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.when(mx <= 0, F.lit(UNKNOWN)).otherwise(out)


def type_expr(text_lc: Column, rules: RuleSet) -> Column:
    """L3: arg-max bucket; all zero -> Unknown; ties by tie-break, then alphabetical."""
    return type_from_scores({label: bucket_score(text_lc, phrases, rules)
                             for label, phrases in rules.types}, rules)


def outcome_expr(tail_lc: Column, rules: RuleSet) -> Column:
    """L4: first label in priority order with a guarded phrase hit in the tail;
    a Refund hit is skipped when any refund negation occurs in the tail."""
    blocked = tx.contains_any(tail_lc, rules.refund_negations)
    out = None
    for label in rules.outcome_priority:
        phrases = _nonblank(rules.outcome_phrases(label))
        if not phrases:
            continue
        hit = F.lit(False)
        for p in phrases:
            hit = hit | tx.negation_guard(tail_lc, p, rules.negation_words)
        if label == "Refund":
            hit = hit & ~blocked
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    if out is None:
        return F.lit(UNKNOWN)
    return out.otherwise(F.lit(UNKNOWN))


def with_text_features(df: DataFrame, rules: RuleSet, text_col: str = "transcript") -> DataFrame:
    """Shared sub-expressions: lower-cased text, tokens, lower-cased tail."""
    out = df.withColumn("_lc", F.lower(tx.safe_text(text_col)))
    if "_tok" not in df.columns:                      # reuse the gate's tokens when present
        out = out.withColumn("_tok", tx.tokens(text_col))
    return (out
              .withColumn("_tail", F.lower(F.array_join(
                  tx.tail_tokens("_tok", rules.outcome_window_frac), " "))))


def apply_labels(df: DataFrame, rules: RuleSet = DEFAULT_RULES, *,
                 duration_cutoff_override: int | None = None,
                 text_col: str = "transcript", duration_col: str = "duration_seconds") -> DataFrame:
    """Add Connected, Type, Outcome (replacing any existing columns).

    Bucket scores are materialized once as columns so the phrase searches are not
    repeated inside the arg-max; the token array is shared by L1 and the tail.
    """
    rules = rules.with_cutoff(duration_cutoff_override)
    dur = F.col(duration_col) if duration_col in df.columns else F.lit(None).cast("double")
    feats = with_text_features(df, rules, text_col)
    names = {label: f"_score{i}" for i, (label, _) in enumerate(rules.types)}
    for label, phrases in rules.types:
        feats = feats.withColumn(names[label], bucket_score(F.col("_lc"), phrases, rules))
    scores = {label: F.col(c) for label, c in names.items()}
    labels = F.struct(connected_expr(dur, F.col("_lc"), F.size("_tok"), rules).alias("Connected"),
                      type_from_scores(scores, rules).alias("Type"),
                      outcome_expr(F.col("_tail"), rules).alias("Outcome"))
    keep = [c for c in df.columns if c not in ("Connected", "Type", "Outcome", "_tok")]
    # The labels come out of a one-row ``inline`` generator: a later filter on Type or
    # Outcome cannot be pushed below a generator's output, so the optimizer never
    # re-inlines the phrase searches into that filter (which would evaluate them twice
    # and blow the 64 KB codegen limit).
    out = feats.select(*keep, F.inline(F.array(labels)))
    return out.select(*keep, "Connected", "Type", "Outcome")


def prefer_existing(primary, fallback) -> Column:
    """Keep a user-supplied label unless it is blank or 'unknown' (any case)."""
    p = F.col(primary) if isinstance(primary, str) else primary
    f = F.col(fallback) if isinstance(fallback, str) else fallback
    usable = p.isNotNull() & (tx.unicode_trim(p) != "") & (F.lower(tx.unicode_trim(p)) != "unknown")
    return F.when(usable, p).otherwise(f)


def relabel(df: DataFrame, rules: RuleSet = DEFAULT_RULES, *,
            duration_cutoff_override: int | None = None) -> DataFrame:
    """Recompute labels, then prefer existing Type/Outcome (Connected always recomputed)."""
    base = df
    for c in ("Type", "Outcome"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    base = base.withColumnRenamed("Type", "_user_type").withColumnRenamed("Outcome", "_user_outcome")
    lab = apply_labels(base, rules, duration_cutoff_override=duration_cutoff_override)
    cols = [c for c in df.columns if c != "_tok"] + [c for c in ("Connected", "Type", "Outcome") if c not in df.columns]
    return (lab.withColumn("Type", prefer_existing("_user_type", "Type"))
               .withColumn("Outcome", prefer_existing("_user_outcome", "Outcome"))
               .select(*cols))


def explain_matches(text_col: str, rules: RuleSet, max_items: int = 5) -> Column:
    """Up to ``max_items`` strings ``[label] …phrase…`` for guarded hits on the whole
    lower-cased text; type rules first (configured order), then outcomes."""
    lc = F.lower(tx.safe_text(text_col))
    items = []
    for label, phrases in rules.types:
        for kw in _nonblank(phrases):
            items.append(F.when(tx.negation_guard(lc, kw, rules.negation_words),
                                F.lit(f"[{label}] …{kw}…")))
    for label in rules.explain_outcome_order:
        for ph in _nonblank(rules.outcome_phrases(label)):
            items.append(F.when(tx.negation_guard(lc, ph, rules.negation_words),
                                F.lit(f"[{label}] …{ph}…")))
    if not items or max_items <= 0:
        return F.array().cast("array<string>")
    return F.slice(F.array_compact(F.array(*items)), 1, int(max_items))


def collect_hits(text_col: str, rules: RuleSet, cap: int = 5) -> Column:
    """``[label] …phrase…`` for phrases present (no guard), type rules then outcomes,
    de-duplicated in first-seen order, capped."""
    lc = F.lower(tx.safe_text(text_col))
    items = []
    for label, phrases in rules.types:
        for kw in _nonblank(phrases):
            items.append(F.when(F.instr(lc, kw.lower()) > 0, F.lit(f"[{label}] …{kw}…")))
    for label in rules.explain_outcome_order:
        for ph in _nonblank(rules.outcome_phrases(label)):
            items.append(F.when(F.instr(lc, ph.lower()) > 0, F.lit(f"[{label}] …{ph}…")))
    if not items:
        return F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.array_compact(F.array(*items))), 1, int(cap))


def rule_hits(df: DataFrame, rules: RuleSet, text_col: str = "transcript",
              id_col: str = "call_id") -> DataFrame:
    """L8 (row level): one row per (call, kind, label, phrase) guarded hit.

    The rule set is compiled into a per-row array of structs and exploded — no
    join, so the work stays a narrow map over the calls.
    """
    # lower-case once; every phrase test below reads the materialized column
    base = df.select(F.col(id_col), F.lower(tx.safe_text(text_col)).alias("_lc"))
    lc = F.col("_lc")
    items = []
    for label, phrases in rules.types:
        for kw in _nonblank(phrases):
            items.append(F.when(tx.negation_guard(lc, kw, rules.negation_words),
                                F.struct(F.lit("type").alias("kind"), F.lit(label).alias("label"),
                                         F.lit(kw).alias("phrase"))))
    for label, phrases in rules.outcomes:
        for ph in _nonblank(phrases):
            items.append(F.when(tx.negation_guard(lc, ph, rules.negation_words),
                                F.struct(F.lit("outcome").alias("kind"), F.lit(label).alias("label"),
                                         F.lit(ph).alias("phrase"))))
    hits = F.array_compact(F.array(*items))
    return (base.select(F.col(id_col), F.explode(hits).alias("h"))
              .select(id_col, "h.kind", "h.label", "h.phrase"))


def rule_hit_counts(df: DataFrame, rules: RuleSet, text_col: str = "transcript") -> DataFrame:
    """Number of calls hitting each rule phrase (map-side partial aggregation)."""
    return (rule_hits(df, rules, text_col).groupBy("kind", "label", "phrase")
            .agg(F.count(F.lit(1)).alias("n_calls")))


# ------------------------------------------------- rules as a table: any number of phrases
def rules_table(spark, rules: RuleSet) -> DataFrame:
    """kind, label, phrase and place (``explain_matches``' order) of a rule set's phrases."""
    rows = [("type", label, p) for label, phrases in rules.types for p in _nonblank(phrases)]
    rows += [("outcome", label, p) for label in rules.explain_outcome_order for p in _nonblank(rules.outcome_phrases(label))]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "kind string, label string, phrase string, place long")


def table_hits(df: DataFrame, rules: DataFrame, text_col: str = "transcript", id_col: str = "call_id",
               negation_words: Sequence[str] = tuple(tx.NEGATION_WORDS)) -> DataFrame:
    """L8 (row level) for phrases in a table (kind, label, phrase): one row per guarded hit, as ``rule_hits`` gives.

    Phrases are found by automata, so thousands of them cost one pass over the texts and no expression each; the
    negation guard (T4) looks at the characters that come with each hit."""
    given = rules.select("kind", "label", "phrase", F.lower("phrase").alias("_needle"), *[c for c in ("place",) if c in rules.columns])
    given = given.where(F.col("phrase").rlike(r"\S"))
    texts = df.select(F.col(id_col), F.lower(tx.safe_text(text_col)).alias("_lc"))
    found = first_places(texts, id_col, "_lc", given, "_needle", tx.NEGATION_WINDOW)
    clear = found.where(~F.col("_before").rlike(tx.negation_regex(negation_words)))
    return clear.join(given, "_needle").withColumnRenamed("_row", id_col).drop("_needle", "_before")


def table_hit_counts(df: DataFrame, rules: DataFrame, text_col: str = "transcript", **options) -> DataFrame:
    """Number of calls hitting each phrase of a table of rules."""
    return table_hits(df, rules, text_col, **options).groupBy("kind", "label", "phrase").agg(F.count(F.lit(1)).alias("n_calls"))


def explain_by_table(df: DataFrame, rules: DataFrame, max_items: int = 5, text_col: str = "transcript", id_col: str = "call_id",
                     **options) -> DataFrame:
    """L6 for phrases in a table with a ``place``: (id, matches), the first ``max_items`` of each call that has hits.

    Ids must be unique. Only the first places of a call leave the tasks that find them (a limited window)."""
    hits = table_hits(df, rules, text_col, id_col, **options)
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("place"))).where(F.col("_n") <= max(0, int(max_items)))
    text = F.concat(F.lit("["), "label", F.lit("] …"), "phrase", F.lit("…"))
    return first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))).alias("m")).select(
        id_col, F.transform("m", lambda x: x["text"]).alias("matches"))
