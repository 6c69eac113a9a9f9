"""Inverted lists and running top-k against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsight.operators import ivf, topk
from callsight.operators import vectors as vec
from callsight.sources import collections


def table(spark, metric, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.concatenate([rng.normal(size=(20, 1, 12)) + 0.2 * rng.normal(size=(20, 40, 12)), np.repeat(rng.normal(size=(1, 1, 12)), 300, 1)
                        .reshape(1, -1, 12)[:, :300]], axis=None).reshape(-1, 12)
    rows = [(f"v{k:04d}", v) for k, v in enumerate(x.tolist())] + [("zero", [0.0] * 12), (None, None), ("v0001", x[1].tolist())]
    return spark.createDataFrame(rows, "doc_id string, vector array<double>"), rows


def brute(rows, queries, k, metric):
    out = {}
    for qid, q in queries:
        found = []
        for i, v in rows:
            if v is None:
                continue
            v, w = np.array(v), np.array(q)
            if metric == "l2":
                d = float(((v - w) ** 2).sum())
            else:
                n = np.linalg.norm(v) * np.linalg.norm(w)
                d = 1.0 - (0.0 if n == 0 else float(v @ w) / n)
            found.append((round(d, 9), str(i)))
        out[qid] = sorted(found)[:k]
    return out


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["doc_id"]))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_search_equals_a_full_scan(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(collections, "FILE_ROWS", 50)
    index, rows = table(spark, metric)
    collections.save_lists(index, str(tmp_path), "c", metric, lists=25)
    stored, lists = collections.open_lists(spark, str(tmp_path), "c")
    assert stored.count() == len(rows) - 1 == lists.sizes.sum() and len(lists.centroids) == 25
    queries = [(f"q{k}", rows[k][1]) for k in range(0, 800, 37)] + [("zero", [0.0] * 12), ("hot", rows[850][1])]
    frame = spark.createDataFrame(queries, "query_id string, qvec array<double>")
    for k in (1, 7, 400):
        got = answers(ivf.search(stored, lists, frame, k, probes=1, exact=True, rank_digits=9))
        assert got == brute(rows, queries, k, metric)
    probes, reached = ivf.calibrate(stored, lists, frame, 7, 0.9, rank_digits=9)
    assert reached >= 0.9 and probes < 25
    few = ivf.search(stored, lists, frame, 7, probes, rank_digits=9)
    full = spark.createDataFrame([(q, i) for q, found in brute(rows, queries, 7, metric).items() for _, i in found], "query_id string, doc_id string")
    assert ivf.recall(few, full) == pytest.approx(reached)
    assert ivf.search(stored, lists, frame, 0).count() == 0


def test_lists_not_probed_are_not_read(spark, tmp_path):
    index, rows = table(spark, "cosine")
    collections.save_lists(index, str(tmp_path), "c", "cosine", lists=20)
    stored, lists = collections.open_lists(spark, str(tmp_path), "c")
    one = spark.createDataFrame([("q", rows[0][1])], "query_id string, qvec array<double>")
    plan = ivf.search(stored, lists, one, 3, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, vector array<double>")
    assert collections.open_lists(spark, str(tmp_path), "c") is None
    collections.save_lists(empty, str(tmp_path), "c")
    stored, lists = collections.open_lists(spark, str(tmp_path), "c")
    one = spark.createDataFrame([("q", [1.0])], "query_id string, qvec array<double>")
    assert ivf.search(stored, lists, one, 3, exact=True).count() == 0


def test_running_top_k_with_ties(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(2))
    keys = rng.integers(0, 6, (500, 9)).astype(float)
    ids = np.array([f"{k:03d}" for k in rng.permutation(500)])
    best = topk.RunningTopK(9, 4)
    best.room = 20
    for a in range(0, 500, 33):
        best.add(keys[a:a + 33, :5], keys[a:a + 33, :5], ids[a:a + 33])
        best.add(keys[a:a + 33, 5:], keys[a:a + 33, 5:], ids[a:a + 33], np.arange(5, 9))
    q, distance, found = best.result()
    for k in range(9):
        assert list(zip(distance[q == k], found[q == k])) == sorted(zip(keys[:, k], ids))[:4]


def test_knn_in_blocks_and_slices(spark, monkeypatch):
    index, rows = table(spark, "cosine")
    queries = [(f"q{k}", rows[k][1]) for k in range(0, 800, 29)]
    frame = spark.createDataFrame(queries, "query_id string, qvec array<double>")
    want = brute(rows, queries, 5, "cosine")
    assert answers(vec.knn(index, frame, 5, rank_digits=9)) == want
    monkeypatch.setattr(vec, "QUERY_BLOCK", 6)
    monkeypatch.setattr(topk, "CELLS", 64)
    assert answers(vec.knn(index, frame, 5, rank_digits=9)) == want


def test_embedding_counts_of_sorted_buckets(spark):
    docs = spark.createDataFrame([("a", "x y x z x"), ("b", "x"), ("c", ""), ("d", None)], "doc_id string, text string")
    for r in vec.hash_embed(docs).collect():
        assert list(r["vec_idx"]) == sorted(set(r["vec_idx"])) and len(r["vec_idx"]) == len(r["vec_val"])
    a = {r["doc_id"]: r["vec_val"] for r in vec.hash_embed(docs).collect()}
    assert sorted(round(v * v * 11) for v in a["a"]) == [1, 1, 9] and a["b"] == [1.0] and a["c"] == a["d"] == []
