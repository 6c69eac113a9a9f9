"""Stored labels: what is looked up, what is labeled, and by which rules."""

from dataclasses import replace

from callsight.operators import labels as lab
from callsight.sources import labels as store

RULES = lab.RuleSet(min_tokens=1, types=(("Support", ("error",)),), outcomes=(("Refund", ("refund",)),))


def calls(spark, rows):
    return spark.createDataFrame(rows, "call_id string, transcript string, duration_seconds double, Type string")


def fresh(frame):
    return {(r["call_id"], r["Type"], r["fresh"]) for r in frame.collect()}


def test_only_new_texts_are_labeled(spark, tmp_path):
    root = str(tmp_path)
    first = calls(spark, [("a", "an error here", 40.0, "old"), ("b", "an error here", 40.0, None), ("c", "hello", 40.0, None), ("n", None, None, None)])
    assert fresh(store.label_calls(first, root, RULES)) == {("a", "Support", True), ("b", "Support", True), ("c", "Unknown", True), ("n", "Unknown", True)}
    assert store.open_labels(spark, root, RULES).count() == 3
    second = calls(spark, [("d", "an error here", 40.0, None), ("e", "an error here", 41.0, None), ("f", "new", None, None), ("g", None, None, None)])
    assert fresh(store.label_calls(second, root, RULES)) == {("d", "Support", False), ("e", "Support", True), ("f", "Unknown", True), ("g", "Unknown", False)}
    again = store.label_calls(second, root, RULES)
    assert {r["fresh"] for r in again.collect()} == {False} and again.count() == 4
    runs = len(list((tmp_path / store.rules_digest(RULES)).glob("run-*")))
    assert runs == 2  # nothing new, nothing written
    store.compact(spark, root, RULES)
    assert {r["fresh"] for r in store.label_calls(second, root, RULES).collect()} == {False}
    assert store.open_labels(spark, root, RULES).count() == 5


def test_changed_rules_miss(spark, tmp_path):
    rows = calls(spark, [("a", "an error here", 40.0, None)])
    store.label_calls(rows, str(tmp_path), RULES).collect()
    for other in (replace(RULES, types=(("Support", ("other",)),)), replace(RULES, negation_words=("x",)), replace(RULES, duration_cutoff_s=31)):
        assert store.rules_digest(other) != store.rules_digest(RULES)
        assert [r["fresh"] for r in store.label_calls(rows, str(tmp_path), other).collect()] == [True]
    assert [r["fresh"] for r in store.label_calls(rows, str(tmp_path), RULES).collect()] == [False]


def test_look_up_reads_the_buckets_of_its_keys(spark, tmp_path):
    store.label_calls(calls(spark, [(str(k), f"text {k}", 40.0, None) for k in range(200)]), str(tmp_path), RULES).collect()
    held = store.open_labels(spark, str(tmp_path), RULES)
    assert held.count() == 200 and held.select("bucket").distinct().count() == store.BUCKETS
    plan = held.where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_no_calls(spark, tmp_path):
    assert store.label_calls(calls(spark, []), str(tmp_path), RULES).count() == 0
    assert store.open_labels(spark, str(tmp_path), RULES).count() == 0
