import math

from pyspark.sql import functions as F

from callsight.functions import text as tx
from callsight.operators import labels as lab

RULES = lab.RuleSet(
    duration_cutoff_s=30, min_tokens=40, short_disconnected_s=10,
    disconnection_cues=("voicemail", "leave a message", "the number you have dialed"),
    types=(("Inquiry", ("information", "status", "question about")),
           ("Billing/Sales", ("bill", "invoice", "payment")),
           ("Support", ("error", "not working", "reset", "broken")),
           ("Complaint", ("complaint", "unhappy", "escalate"))),
    outcomes=(("Resolved", ("issue is resolved", "should work now")),
              ("Callback", ("we will call you back", "follow up")),
              ("Refund", ("processed the refund", "issued a refund")),
              ("Sale-close", ("order placed", "payment processed"))),
    refund_negations=("refund denied", "no refund"),
)


def _label(spark, rows):
    df = spark.createDataFrame(rows, "call_id string, duration_seconds double, transcript string")
    return {r.call_id: r for r in lab.apply_labels(df, RULES).collect()}


def test_connected_rules(spark):
    words = lambda n: " ".join(["word"] * n)
    out = _label(spark, [("a", 40.0, words(45)), ("b", 40.0, words(10)), ("c", 5.0, words(100)),
                         ("d", 120.0, "please leave a message " + words(60)), ("e", None, words(60)),
                         ("f", math.nan, words(60))])
    assert out["a"].Connected == "Connected"
    assert [out[k].Connected for k in "bcdef"] == ["Disconnected"] * 5


def test_type_and_tie_break(spark):
    out = _label(spark, [("a", 60.0, "there is an error with the router"),
                         ("b", 60.0, "complaint about an error"),
                         ("c", 60.0, "nothing relevant here")])
    assert out["a"].Type == "Support"
    assert out["b"].Type == "Complaint"          # 1-1 tie, Complaint wins the tie-break
    assert out["c"].Type == "Unknown"


def test_outcome_tail_and_refund_block(spark):
    filler = " ".join(["talk"] * 30)
    out = _label(spark, [("a", 60.0, filler + " we processed the refund today"),
                         ("b", 60.0, filler + " processed the refund but refund denied sorry"),
                         ("c", 60.0, "processed the refund " + filler)])
    assert out["a"].Outcome == "Refund"
    assert out["b"].Outcome != "Refund"
    assert out["c"].Outcome == "Unknown"         # phrase outside the last 25 % of tokens


def test_negation_window_19_20_21(spark):
    def text(gap):
        return "no" + " " * (gap - 2) + "error"        # 'no' starts gap chars before the phrase
    df = spark.createDataFrame([(19, text(19)), (20, text(20)), (21, text(21))], "g int, t string")
    got = {r.g: r.ok for r in df.select("g", tx.negation_guard(F.col("t"), "error").alias("ok")).collect()}
    assert got == {19: False, 20: False, 21: True}


def test_tokens_and_tail(spark):
    df = spark.createDataFrame([("Hello é-cole 9ab x_y don't",)], "t string")
    r = df.select(tx.tokens("t").alias("k"), tx.tail_text("t", 0.5).alias("tail")).first()
    assert r.k == ["Hello", "cole", "ab", "x_y", "don't"]
    assert r.tail == "ab x_y don't"


def test_prefer_existing(spark):
    df = spark.createDataFrame([("a", 60.0, "an error", "Complaint"), ("b", 60.0, "an error", " unknown "),
                                ("c", 60.0, "an error", None)],
                               "call_id string, duration_seconds double, transcript string, Type string")
    out = {r.call_id: r.Type for r in lab.relabel(df, RULES).collect()}
    assert out == {"a": "Complaint", "b": "Support", "c": "Support"}


def test_mask_name(spark):
    df = spark.createDataFrame([("Jane Smith",), ("J",), ("  ",), (None,)], "n string")
    got = [r.m for r in df.select(tx.mask_name("n").alias("m")).collect()]
    assert got == ["J*** S****", "J*", "  ", None]


def test_thousands_of_phrases_as_a_table(spark):
    """The same hits as one expression a phrase, and as a plain loop for phrases that no plan could spell out."""
    import random
    import re

    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    phrases = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(2500)] + words[:2500] + ["  ", "W7 W8"]
    texts = [" ".join(rng.choice(words + ["no", "never", "denied"] * 60) for _ in range(120)) for _ in range(40)] + ["", None, "w7 W8"]
    calls = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "call_id string, transcript string")
    table = spark.createDataFrame([("type", "L%d" % (k % 7), p, k) for k, p in enumerate(phrases)], "kind string, label string, phrase string, place long")
    guard = re.compile(r"(^|[^\w])(no|not|never|without|deny|denied|denies)([^\w]|$)")
    want = []
    for k, t in enumerate(texts):
        low = (t or "").lower()
        for place, p in enumerate(phrases):
            at = low.find(p.lower())
            if p.strip() and at >= 0 and not guard.search(low[max(0, at - 20):at]):
                want.append((str(k), "L%d" % (place % 7), p, place))
    got = sorted((r.call_id, r.label, r.phrase, r.place) for r in lab.table_hits(calls, table).collect())
    assert got == sorted(want) and len(want) > 2000
    explained = {r.call_id: r.matches for r in lab.explain_by_table(calls, table, 3).collect()}
    for call in {w[0] for w in want}:
        first = sorted((w[3], f"[{w[1]}] …{w[2]}…") for w in want if w[0] == call)[:3]
        assert explained.pop(call) == [x for _, x in first]
    assert not explained


def test_rules_table_gives_the_hits_of_a_rule_set(spark):
    calls = spark.createDataFrame([("a", "an error and a refund issued a refund"), ("b", "no error here"), ("b", "issue with error"), (None, "error")],
                                  "call_id string, transcript string")
    rules = lab.RuleSet(types=(("Support", ("error", "issue", " ")), ("Complaint", ("error",))), outcomes=(("Refund", ("issued a refund",)),))
    table = lab.rules_table(spark, rules)
    key = lambda df: sorted((str(r.call_id), r.kind, r.label, r.phrase) for r in df.collect())
    assert key(lab.table_hits(calls, table)) == key(lab.rule_hits(calls, rules))
    assert lab.table_hits(calls, table.limit(0)).count() == 0
