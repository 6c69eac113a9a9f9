"""What keeps work in step with the input: texts joined once, frames computed once, bounded pieces inside the tasks."""

import hashlib
import math
import tempfile
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callsight.operators import patterns, topk
from callsight.operators import vectors as vec
from callsight.operators.normalize import normalize_calls
from callsight.plans import fixtures as fx
from callsight.sources import io


def _tables(spark):
    root = tempfile.mkdtemp(prefix="cs-tables-")
    rows = {"documents": ([(1, "one", 3), (2, "two", 3), (2, "two again", 9), (None, "lost", 4), (9, "no order", 8)], "doc_id long, text string, n_chars long"),
            "orders": ([(1, 10, 5.0, "1-URGENT"), (2, 11, 6.0, "5-LOW"), (2, 10, 7.0, "3-MEDIUM"), (None, 10, 1.0, "2-HIGH"), (3, 10, 1.0, "2-HIGH")],
                       "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"),
            "customer": ([(10, "C10", "AUTO"), (11, "C11", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string"),
            "part": ([(7, "bolt")], "p_partkey long, p_name string"),
            "lineitem": ([(1, 2, 8, 4, 1.0), (1, 1, 7, 3, 2.0), (3, 1, 7, 3, 2.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")}
    for name, (data, schema) in rows.items():
        df = spark.createDataFrame(data, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.lit("1995-03-01").cast("date"))
        df.write.parquet(f"{root}/{name}.parquet")
    return root


def _text_joins(df):
    found, todo = 0, [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join" and "text#" in node.output().mkString(","):
            found += 1
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_texts_are_joined_once(spark):
    """The text meets the other tables in one join, with or without the priority, and the rows are those of plain joins."""
    root = _tables(spark)
    calls = fx.calls_with_raw_labels(spark, root)
    assert _text_joins(calls) == 1 and _text_joins(fx.prioritized_calls(spark, root)) == 1
    got = sorted((r.call_id, r.transcript, r.customer_name, r.product_name, r.agent_id) for r in calls.collect())
    two = [("2", t, c, None, None) for t in ("two", "two again") for c in ("C10", "C11")]
    assert got == [("1", "one", "C10", "bolt", "A003"), *two]
    plain = calls.join(fx.order_priority(spark, root), "order_id")
    assert sorted(map(str, plain.collect())) == sorted(map(str, fx.prioritized_calls(spark, root).collect()))


def test_embedding_is_pruned_and_counts_words(spark):
    """No generators; a plan that needs no vector computes none; the values are those of a plain loop."""
    texts = ["b a b\x1cC c", "", None, " ", "É é x" * 3, "w" * 100 + " z", "a " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = vec.hash_embed(docs)
    assert "Generate" not in e._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in e.select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    for r in e.collect():
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384 for w in (texts[r.doc_id] or "").lower().split())
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert dict(zip(r.vec_idx, r.vec_val)) == {b: n / norm for b, n in counts.items()} and r.vec_idx == sorted(counts)


def test_blank_documents_and_trimmed_texts(spark):
    rows = [("a", " x y "), ("b", " \t "), ("c", None), ("d", "plain"), ("e", "\n")]
    docs = vec.prepare_docs(spark.createDataFrame(rows, "call_id string, transcript string"))
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [("a", "x y"), ("d", "plain")]


def _counted(spark, rows, schema):
    """Rows whose every computation is counted."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return spark.createDataFrame(rows, schema).withColumn("call_id", F.udf(count, "string")("call_id")), seen


def test_rank_intersect_computes_its_scope_once(spark):
    """F2"""
    scope, seen = _counted(spark, [(c,) for c in "ABCD"], "call_id string")
    ranked = spark.createDataFrame([("C", 1), ("A", 2)], "doc_id string, rank int")
    assert [r.call_id for r in vec.rank_intersect(scope, ranked).collect()] == ["C", "A"]
    assert seen.value == 4


def test_index_build_computes_its_calls_once(spark):
    """F4"""
    root = tempfile.mkdtemp(prefix="cs-once-")
    for n, rebuild in ((6, True), (3, False)):
        calls, seen = _counted(spark, [(str(k), f"text {k} {n}") for k in range(n)], "call_id string, transcript string")
        assert io.build_index(calls, root, "c", rebuild=rebuild) == 6 and seen.value == n


def test_all_rows_are_numbered_in_ranges(spark):
    """the numbers of a window over everything, without one."""
    rows = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 11).alias("rank"), F.col("id").cast("string").alias("call_id"))
    rows = rows.union(rows.limit(0)).repartition(6)
    order = (F.col("rank").asc_nulls_last(), F.col("call_id"))
    out = vec.numbered_in_order(rows, order, "position")
    wanted = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    shown = vec.present(rows.select("call_id"), "q", semantic=False, top_k=3).collect()
    assert [r.call_id for r in sorted(shown, key=lambda r: r.position)] == sorted(str(k) for k in range(5000))
    assert vec.present(rows.select("call_id").limit(0), "q", semantic=False, top_k=3).count() == 0


def test_blocks_of_vectors_are_bounded():
    """a slice's vectors are bounded, however few queries there are."""
    parts = list(topk.slices(10_000, 1, 384))
    assert max(end - first for first, end in parts) * 384 <= topk.CELLS <= 1 << 20
    assert [first for first, _ in parts] == [0, *[end for _, end in parts[:-1]]] and parts[-1][1] == 10_000


def test_hits_leave_the_task_in_pieces():
    """the hits of a few texts at a time."""
    texts = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(["no aa ab"] * 1000)], ["_row", "text"])
    out = list(patterns._first(SimpleNamespace(value=["aa", "ab"]), 3)(iter([texts])))
    assert max(b.num_rows for b in out) <= 2 * patterns.ROWS and sum(b.num_rows for b in out) == 2000
    assert np.concatenate([b.column(0).to_numpy() for b in out]).tolist() == [k for k in range(1000) for _ in "ab"]


@pytest.mark.parametrize("rows_of_part", [1, 1 << 15])
def test_merge_of_months_in_parts(spark, monkeypatch, rows_of_part):
    """A month's calls lie in parts by key; repeated, null and replaced keys are merged as before, in one shuffle."""
    monkeypatch.setattr(io, "PART_ROWS", rows_of_part)
    root = tempfile.mkdtemp(prefix="cs-parts-") + "/calls"

    def upload(rows):
        df = spark.createDataFrame(rows, "call_id string, start_time string, amount string, seq int")
        return normalize_calls(df, keep=["seq"])

    first = [(f"c{k}", f"2025-0{1 + k % 2}-10 09:00:00", str(k), 0) for k in range(20)] + [("c1", "2025-02-10 09:00:00", "70", 2), ("c1", "2025-02-10 09:00:00", "60", 1),
                                                                                         (None, None, "1", 1), (None, None, "2", 2)]
    io.merge_calls_snapshot(upload(first), root, ("seq",), tz="UTC")
    io.merge_calls_snapshot(upload([("c2", "2025-01-10 09:00:00", "99", 0), (None, None, "3", 0), ("new", "2025-03-01 00:00:00", "5", 0)]), root, ("seq",), tz="UTC")
    got = {(r.call_id, r.start_month): r.amount for r in io.load_snapshot(spark, root).collect()}
    wanted = {(f"c{k}", f"2025-0{1 + k % 2}"): float(k) for k in range(20)} | {("c1", "2025-02"): 70.0, ("c2", "2025-01"): 99.0, (None, None): 3.0, ("new", "2025-03"): 5.0}
    assert got == wanted and io.load_snapshot(spark, root).count() == len(wanted)
