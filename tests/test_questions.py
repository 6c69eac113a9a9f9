import datetime as dt

from callsight.operators import questions as qx


def _parse(spark, text, as_of=dt.date(2025, 8, 20)):
    df = spark.createDataFrame([("q", text, as_of)], "question_id string, text string, as_of date")
    return qx.parse_questions(df).first()


def test_single_date_and_type(spark):
    r = _parse(spark, "sales on 2025-08-13")
    assert (str(r.date_from), str(r.date_to)) == ("2025-08-13", "2025-08-13")
    assert r.type_any == ["Billing/Sales"]


def test_refunds_amounts_agent_relative(spark):
    r = _parse(spark, "refunds last week from $50 to $200 for agent Alice in campaign Sales-EMEA")
    assert r.outcome_any == ["Refund"]
    assert (r.min_amount, r.max_amount) == (50.0, 200.0)
    assert "Alice in campaign" in r.agent_words
    assert (str(r.date_from), str(r.date_to)) == ("2025-08-11", "2025-08-17")


def test_yesterday_dates_only(spark):
    r = _parse(spark, "show me everything for yesterday")
    assert (str(r.date_from), str(r.date_to)) == ("2025-08-19", "2025-08-19")
    assert r.type_any == [] and r.min_amount is None


def test_grounding_and_resolution(spark):
    qs = spark.createDataFrame([("q1", "calls for sales-emea about widget pro by rep ali")],
                               "question_id string, text string")
    cat = spark.createDataFrame([("campaign", "Sales-EMEA"), ("product", "Widget Pro"), ("product", "Widget"),
                                 ("agent", "Alice"), ("agent", "Bob")], "kind string, value string")
    g = {r.kind: r["values"] for r in qx.ground_entities(qs, cat).collect()}
    assert g == {"campaign": ["Sales-EMEA"], "product": ["Widget", "Widget Pro"]}
    toks = spark.createDataFrame([("q1", 0, "ali")], "question_id string, pos int, token string")
    res = qx.resolve_entities(toks, cat.filter("kind = 'agent'")).first()
    assert res.resolved == ["Alice"]


def test_restrict_specs(spark):
    df = spark.createDataFrame(
        [("q", None, None, ["Support"], ["Refund"], ["A1"], ["X"], ["p"], 1.0, 2.0)],
        "question_id string, date_from date, date_to date, type_any array<string>, outcome_any array<string>, "
        "agents array<string>, campaigns array<string>, products array<string>, min_amount double, "
        "max_amount double")
    r = qx.restrict_specs(df, ["type_any", "min_amount"]).first()
    assert r.type_any == ["Support"] and r.outcome_any == [] and r.agents == [] and r.min_amount == 1.0
    assert r.max_amount is None
