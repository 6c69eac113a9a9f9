from callsight.operators import vectors as vec


def test_hash_knn_finds_refund_doc(spark):
    docs = spark.createDataFrame([("c1", "refund policy and returns"),
                                  ("c2", "technical support for home router setup"),
                                  ("c3", "billing issue found on monthly invoice")], "doc_id string, text string")
    idx = vec.hash_embed(docs, "doc_id", "text")
    q = vec.question_vectors(spark.createDataFrame([("q", "requesting a refund for returned item")],
                                                   "question_id string, text string"))
    hits = [r.doc_id for r in vec.knn(idx, q, k=2).collect()]
    assert "c1" in hits and len(hits) == 2
    assert vec.knn(idx, q, k=0).count() == 0


def test_rank_intersect_order_and_fallback(spark):
    scope = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "call_id string")
    ranked = spark.createDataFrame([("C", 1), ("A", 2), ("E", 3)], "doc_id string, rank int")
    out = [r.call_id for r in vec.rank_intersect(scope, ranked).orderBy("rank").collect()]
    assert out == ["C", "A"]
    none = spark.createDataFrame([("X", 1)], "doc_id string, rank int")
    assert vec.rank_intersect(scope, none).count() == 4


def test_pluggable_embedder(spark):
    """V7: any DataFrame -> vector function plugs in, e.g. an Arrow-batched pandas UDF model."""
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def letter_counts(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [float(t.count(c)) for c in "aeiou"])

    def embedder(df, id_col, text_col):
        return df.withColumn("vector", letter_counts(F.col(text_col)))

    docs = spark.createDataFrame([("d1", "aaa"), ("d2", "eee"), ("d3", "aae")], "doc_id string, text string")
    idx = vec.embed_texts(docs, "doc_id", "text", embedder=embedder)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0, 0.0])], "query_id string, qvec array<double>")
    top = vec.knn(idx, q, k=1).first()
    assert top.doc_id == "d1"


def test_rerank_scope_and_indexed_agree(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([("a", "red apple pie", "x"), ("b", "green pear", "y"), ("c", "apple tart", "x")],
                                 "doc_id string, text string, kind string")
    idx = vec.hash_embed(docs.withColumn("metadata", F.create_map(F.lit("kind"), F.col("kind"))), "doc_id", "text")
    q = vec.question_vectors(spark.createDataFrame([("q", "apple")], "question_id string, text string"))
    scope = spark.createDataFrame([("a",), ("c",)], "call_id string")
    j = {r.call_id: round(r.distance, 9) for r in vec.rerank_scope(scope, idx, q).collect()}
    i = {r.doc_id: round(r.distance, 9)
         for r in vec.rerank_indexed(idx, q, F.col("metadata")["kind"] == "x").collect()}
    assert j == i and set(j) == {"a", "c"}


def test_embedding_keeps_rows_of_one_id(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("a", "z"), (None, "x"), (None, None), ("b", " ")], "doc_id string, text string")
    rows = vec.hash_embed(docs).collect()
    assert sorted((str(r.doc_id), str(r.text), len(r.vec_idx)) for r in rows) == [
        ("None", "None", 0), ("None", "x", 1), ("a", "x y x", 2), ("a", "z", 1), ("b", " ", 0)]
    two = next(r for r in rows if r.text == "x y x")
    assert sorted(round(v, 6) for v in two.vec_val) == [round(1 / 5 ** 0.5, 6), round(2 / 5 ** 0.5, 6)]
    assert "Exchange" not in vec.hash_embed(docs)._jdf.queryExecution().executedPlan().toString()


def test_rerank_many_queries(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc_id string, vector array<double>")
    queries = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1e-3, 1.0])], "query_id string, qvec array<double>")
    scope = spark.createDataFrame([("a",), ("b",), ("c",)], "call_id string")
    got = {(r.call_id, r.query_id): r.distance for r in vec.rerank_scope(scope, index, queries, "l2").collect()}
    assert len(got) == 6 and got["c", "p"] is None and got["a", "p"] == 0.0 and abs(got["b", "q"] - 1e-6) < 1e-15
    assert vec.rerank_indexed(index, queries).count() == 4


def test_knn_in_blocks_and_small_l2(spark, monkeypatch):
    rows = [(f"d{k:03d}", [1e4 + k * 1e-3, float(k % 7)]) for k in range(200)]
    index = spark.createDataFrame(rows, "doc_id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", [1e4 + k * 1e-3, float(k % 7)]) for k in range(9)], "query_id string, qvec array<double>")
    whole = sorted(map(tuple, vec.knn(index, queries, 4, "l2").collect()))
    monkeypatch.setattr(vec, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, vec.knn(index, queries, 4, "l2").collect())) == whole
    want = {}
    for q in range(9):
        d = sorted((sum((x - y) ** 2 for x, y in zip(v, rows[q][1])), i) for i, v in rows)[:4]
        want[f"q{q}"] = [i for _, i in d]
    for q, ids in want.items():
        assert [r[1] for r in sorted((r for r in whole if r[0] == q), key=lambda r: r[3])] == ids


def test_embedder_of_lists_gets_batches_of_64(spark):
    import pytest

    def embed(texts):
        assert len(texts) <= 64
        return [[len(t), len(texts)] for t in texts]

    docs = spark.createDataFrame([(str(k), "x" * k if k else None) for k in range(150)], "doc_id string, text string").coalesce(1)
    got = {r.doc_id: list(r.vector) for r in vec.embed_texts(docs, "doc_id", "text", vec.batched_embedder(embed)).collect()}
    assert all(got[str(k)][0] == k for k in range(150)) and {v[1] for v in got.values()} <= {64.0, 22.0}
    with pytest.raises(Exception):
        vec.embed_texts(docs, "doc_id", "text", vec.batched_embedder(lambda texts: [[1.0]])).collect()


def test_present_uses_only_a_hook_that_keeps_all_rows(spark):
    from pyspark.sql import functions as F
    scope = spark.createDataFrame([(c,) for c in "dbac"], "call_id string")
    shown = lambda **k: [(r.call_id, r.scope_count) for r in vec.present(scope, "q", **k).orderBy("position").collect()]
    back = lambda s, q: s.withColumn("rank", -F.ascii("call_id"))
    assert shown(semantic=True, top_k=2, reorder=back) == [("d", 4), ("c", 4)]
    assert shown(semantic=True, top_k=0, reorder=back) == [("d", 4)]
    assert shown(semantic=True, top_k=None, reorder=back)[0] == ("d", 4)
    plain = [("a", 4), ("b", 4), ("c", 4), ("d", 4)]
    assert shown(semantic=False, top_k=1, reorder=back) == plain
    for bad in (lambda s, q: back(s, q).limit(3), lambda s, q: back(s, q).union(back(s, q)), lambda s, q: 1 / 0,
                lambda s, q: back(s, q).withColumn("rank", F.raise_error(F.lit("late")))):
        assert shown(semantic=True, top_k=3, reorder=bad) == plain[:3]
    assert vec.present(scope.limit(0), "q", semantic=True, top_k=3, reorder=back).count() == 0
