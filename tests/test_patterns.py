"""Automata over blocks of needles, and specs that find calls by amounts and products, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from callsight.operators import filters as flt
from callsight.operators import patterns


@pytest.mark.parametrize("chars", [1 << 20, 5])
def test_substring_pairs(spark, monkeypatch, chars):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", chars)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "aaaa", "aaaa", "İstanbul 漢字"]
    needles = ["a", "aa", "aaa", "ab", "é", " ", "ba b", "a", "", None, "漢", "stan", "nothing like it"]
    t = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "t long, text string")
    n = spark.createDataFrame([(k, v) for k, v in enumerate(needles)], "n long, needle string")
    got = sorted((r.t, r.n) for r in patterns.substring_pairs(t, "text", n, "needle").collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(needles) if x is not None and y and y in x)
    assert patterns.substring_pairs(t.limit(0), "text", n, "needle").count() == 0
    assert patterns.substring_pairs(t, "text", n.limit(0), "needle").count() == 0


def test_bins_grow_with_amounts(spark):
    values = [-math.inf, -1e300, -5.0, -0.5, 0.0, 0.3, 1.0, 1.1, 49.99, 50.0, 1e6, 1e12, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    bins = [r[0] for r in df.select(flt.amount_bin(F.col("x"))).collect()]
    assert bins == sorted(bins) and bins[-1] == flt._BINS * flt._DOUBLINGS


def test_specs_by_amount_and_product(spark):
    rng = random.Random(9)
    amounts = [None, math.nan, -3.0, 0.0, 50.0, 50.0, 1e13] + [rng.uniform(-20, 3000) for _ in range(200)]
    names = [None, "Widget Pro", "widget lite", "Gadget", "Pro Gadget"]
    calls = [(str(k), rng.choice(names), a, "A1", "Support") for k, a in enumerate(amounts)]
    specs = [("s%d" % k, p, lo, hi) for k, (p, lo, hi) in enumerate([
        ([], 50.0, None), ([], None, 50.0), ([], 40.0, 60.0), ([], 60.0, 40.0), (["WIDGET"], None, None), (["pro", "widget"], None, None),
        (["gadget"], 10.0, 500.0), ([" "], None, None), (["none"], None, None), ([], -5.0, 0.0), ([], 1e13, None)])]
    c = spark.createDataFrame(calls, "call_id string, product_name string, amount double, agent_id string, Type string")
    s = spark.createDataFrame([(i, None, None, [], [], [], [], p, lo, hi) for i, p, lo, hi in specs],
                              "question_id string, date_from date, date_to date, type_any array<string>, outcome_any array<string>, "
                              "agents array<string>, campaigns array<string>, products array<string>, min_amount double, max_amount double")
    c = c.withColumn("start_time", F.lit(None).cast("timestamp"))
    got = sorted((r.question_id, r.call_id) for r in flt.apply_specs(c, s).collect())
    want = []
    for i, p, lo, hi in specs:
        words = [w.strip().lower() for w in p if w.strip()]
        for call, name, a, _, _ in calls:
            top = a is not None and (math.inf if math.isnan(a) else a)
            fits = (lo is None or a is not None and top >= lo) and (hi is None or a is not None and top <= hi)
            if fits and (not words or name is not None and any(w in name.lower() for w in words)):
                want.append((i, call))
    assert got == sorted(want)
    one = flt.apply_specs(c.drop("amount"), s.filter("question_id = 's0'"))
    assert one.count() == len(calls)  # a condition on a column that calls lack says nothing
