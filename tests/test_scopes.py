"""Scopes of many specs by cells of calls: sizes and first calls equal those of the pairs."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from callsight.operators import aggregates as agg
from callsight.operators import filters as flt

CALLS = "call_id string, start_time timestamp, agent_id string, campaign string, product_name string, amount double, Type string, Outcome string"
SPECS = ("question_id string, date_from date, date_to date, type_any array<string>, outcome_any array<string>, agents array<string>, "
         "campaigns array<string>, products array<string>, min_amount double, max_amount double")


def _calls(spark):
    r = random.Random(7)
    pick = lambda *values: r.choice(values)
    rows = [(str(i), pick(None, *[dt.datetime(1995, 3, 25) + dt.timedelta(minutes=r.randrange(60 * 24 * 40)) for _ in range(9)]),
             pick("A1", "a1 ", "A2", None), pick("North", "South", None), pick("Red Cup", "red lamp", "Blue Cup", None),
             pick(None, float("nan"), float("inf"), -5.0, 0.0, 9.0, 9.5, 100.0, 2000.0, r.random() * 3000), pick("Support", "Inquiry"),
             pick("Refund", "Resolved")) for i in range(300)]
    return spark.createDataFrame([*rows, *rows[:9]], CALLS)


def _specs(spark):
    day = lambda n: dt.date(1995, 3, 20) + dt.timedelta(days=n)
    windows = [(None, None), (day(8), None), (day(5), day(30)), (None, day(12)), (day(40), day(2)), (day(0), day(90)), (day(11), day(12)), (day(90), day(99))]
    lists = [([], [], [], [], []), (["support"], [], [], [], []), ([], ["Refund", "resolved"], ["A1", "A2"], [], []),
             ([], [], [" "], [], []), ([], [], [], ["north"], ["cup", "red"]), ([], [], [], [], ["none such"])]
    amounts = [(None, None), (9.0, None), (None, 9.0), (9.0, 2000.0), (100.0, 9.0), (float("nan"), None), (None, 0.0)]
    rows = [(f"s{n}", *w, *x, *a) for n, (w, x, a) in enumerate(itertools.product(windows, lists, amounts))]
    return spark.createDataFrame([*rows, rows[0], rows[20]], SPECS)


def _sorted(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_sizes_and_first_calls_without_pairs(spark):
    calls, specs = _calls(spark), _specs(spark)
    pairs = flt.apply_specs(calls, specs).select("question_id", "Type", "Outcome", "call_id").persist()
    listed = pairs.groupBy("question_id", "Type", "Outcome").agg(F.count(F.lit(1)).alias("n"))
    columns = ("question_id", "Type", "Outcome", "n")
    assert _sorted(flt.apply_specs(calls, specs, by=("Type", "Outcome")), *columns) == _sorted(listed, *columns)
    few = {}
    for r in sorted(map(tuple, pairs.select("question_id", "call_id").collect())):
        few.setdefault(r[0], []).append(r[1])
    wanted = sorted((k, c) for k, cs in few.items() for c in cs[:4])
    assert _sorted(flt.apply_specs(calls, specs, by=("Type",), first=4), "question_id", "call_id") == sorted(wanted, key=repr)
    pairs.unpersist()


def test_two_agent_columns_count_a_call_once(spark):
    calls = _calls(spark).limit(50).withColumn("agent", F.lit("A2"))
    specs = _specs(spark).filter("size(agents) > 0")
    listed = flt.apply_specs(calls, specs).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    assert _sorted(flt.apply_specs(calls, specs, by=()), "question_id", "n") == _sorted(listed, "question_id", "n")


def test_tallies_of_sized_rows(spark):
    rows = spark.createDataFrame([("q", "Support", "Refund", 3), ("q", "Inquiry", "Refund", 4)], "question_id string, Type string, Outcome string, n long")
    out = {r.dim: (r.top3, r.scope_n) for r in agg.scope_tallies(rows, size="n").collect()}
    assert out == {"type": ("Inquiry (4), Support (3)", 7), "outcome": ("Refund (7)", 7)}


def test_sentences_from_sizes_and_shown_rows(spark):
    specs = spark.createDataFrame([("q", None, None), ("none", None, None)], "question_id string, date_from date, date_to date")
    shown = spark.createDataFrame([("q", "Support", "Refund", "1"), ("q", "Support", "Resolved", "2")], "question_id string, Type string, Outcome string, call_id string")
    sizes = spark.createDataFrame([("q", 9)], "question_id string, n long")
    out = {r.question_id: r.answer for r in agg.answer_sentences(shown, specs, shown=2, sizes=sizes).collect()}
    assert out["q"].startswith("Showing top 2 of 9 calls.") and out["none"] == "0 calls in scope."


def test_questions_without_years_hold_no_dates(spark):
    from callsight.operators import questions as qx
    texts = ["calls - of 3 jan", "from 3 jan 2025 to jan 5, 2025", "a jan 3 2025 - b 5.1.2025", "1995-01-02 - 1995-02-03", "between 2025-01-02 and 2025-01-09", None]
    rows = spark.createDataFrame([(i, t, dt.date(2025, 6, 1)) for i, t in enumerate(texts)], "question_id int, text string, as_of date")
    got = {r.question_id: (str(r.date_from), str(r.date_to)) for r in qx.parse_questions(rows).collect()}
    d = "2025-01-{}".format
    assert got[1] == got[2] == (d("03"), d("05")) and got[4] == (d("02"), d("09")) and got[3] == got[5] == ("None", "None")
