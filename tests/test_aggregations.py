import datetime as dt

from callsight.operators import aggregates as agg

ROWS = [("1", "Connected", "Support", "Resolved"), ("2", "Connected", "Support", "Callback"),
        ("3", "Disconnected", "Inquiry", "Refund"), ("4", "Connected", "Billing/Sales", "Sale-close"),
        ("5", "Disconnected", "Unknown", "Unknown")]


def _df(spark):
    return spark.createDataFrame(ROWS, "call_id string, Connected string, Type string, Outcome string")


def test_kpis(spark):
    k = agg.kpis(_df(spark)).first()
    assert (k.total, k.connected, k.disconnected) == (5, 3, 2)
    assert abs(k.pct_connected - 60.0) < 1e-9
    assert k.top_type == "Support"


def test_breakdown_order_and_unknown(spark):
    c = [tuple(r) for r in agg.connection_breakdown(_df(spark)).collect()]
    assert c == [("Connected", 3), ("Disconnected", 2)]
    hidden = [r.Type for r in agg.type_breakdown(_df(spark)).collect()]
    shown = [r.Type for r in agg.type_breakdown(_df(spark), show_unknowns=True).collect()]
    assert "Unknown" not in hidden and shown[-1] == "Unknown" and len(shown) == len(hidden) + 1


def test_by_agent_mode_ties_and_null_group(spark):
    rows = [("a", "A1", "Connected", "Support", "Unknown"), ("b", "A1", "Disconnected", "Inquiry", "Unknown"),
            ("c", None, "Connected", "Unknown", "Refund")]
    df = spark.createDataFrame(rows, "call_id string, agent_id string, Connected string, Type string, Outcome string")
    out = {r.agent_id: r for r in agg.by_agent(df).collect()}
    assert out["A1"].total == 2 and out["A1"].top_type == "Inquiry"     # tie -> smallest
    assert out["A1"].top_outcome == "Unknown"                              # only Unknown present
    assert out[None].top_type == "Unknown" and out[None].pct_connected == 100.0


def test_breakdowns_one_pass_matches_separate(spark):
    df = _df(spark)
    one = {(r.section, r.label): r["count"] for r in agg.breakdowns_one_pass(df).collect()}
    assert one[("Connection", "Connected")] == 3 and one[("Types", "Support")] == 2
    assert one[("Outcomes", "Unknown")] == 1


def test_summary_file_in_its_order(spark, tmp_path):
    import glob

    from callsight.sources import io

    io.write_summary(_df(spark), {"from": "2025-08-01", "agent": "(All)"}, str(tmp_path / "summary"))
    (file,) = glob.glob(str(tmp_path / "summary" / "part-*.csv"))
    with open(file, encoding="utf-8") as lines:
        rows = [line.strip() for line in lines]
    assert rows[:4] == ["section,label,count", "Connection,Connected,3", "Connection,Disconnected,2", "Types,Support,2"]
    assert rows[-3:] == [",,", "Context,from,2025-08-01", "Context,agent,(All)"]


def test_answer_sentences(spark):
    scope = spark.createDataFrame([("q", str(k), "Support" if k % 2 else "Inquiry", "Refund") for k in range(7)],
                                  "question_id string, call_id string, Type string, Outcome string")
    specs = spark.createDataFrame([("q", dt.date(2025, 8, 1), dt.date(2025, 8, 2)), ("none", None, None)],
                                  "question_id string, date_from date, date_to date")
    out = {r.question_id: r.answer for r in agg.answer_sentences(scope, specs, shown=3).collect()}
    assert out["q"] == ("Showing top 3 of 7 calls. Date range: 2025-08-01 → 2025-08-02. Top types: Inquiry (2), Support (1). "
                        "Top outcomes: Refund (3).")
    assert out["none"] == "0 calls in scope."


def test_display_limit_is_applied_inside_the_tasks(spark):
    scope = spark.range(100).selectExpr("'q' AS question_id", "string(id) AS call_id", "'Support' AS Type", "'Refund' AS Outcome")
    specs = spark.createDataFrame([("q", None, None)], "question_id string, date_from date, date_to date")
    out = agg.answer_sentences(scope, specs, shown=5)
    assert "Window Group Limit" in out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")) \
        or "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert out.first().answer.startswith("Showing top 5 of 100 calls.")
