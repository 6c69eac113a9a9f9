"""Statistics, trees, and held-out accuracy on the labelled documents."""

import os

import numpy as np
import pyarrow as pa
import pytest

from callsight.llm import quality


def test_statistics_of_one_text_do_not_depend_on_its_batch():
    texts = ["One two two\nOne two two", None, "", "ABC!! DEF!!", "x" * 300, "é ü | a | b", " \n "]
    together = quality.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.array_equal(together[k], quality.statistics(pa.array([t], pa.string()))[0])
    named = dict(zip(quality.STATISTICS, together[0]))
    assert named["same_as_last"] == pytest.approx(2 / 6) and named["distinct_words"] == pytest.approx(2 / 6)
    assert named["repeated_lines"] == pytest.approx(0.5) and named["capital_words"] == pytest.approx(2 / 6)
    assert dict(zip(quality.STATISTICS, together[3]))["end_bang"] == 1
    assert not together[1].any() and not together[2].any()


def test_flat_trees_follow_their_splits():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = quality.fit(x, y, trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def test_no_labels_or_one_class(spark, docs):
    frame = docs([(1, "a"), (2, None), (None, ""), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(frame, quality.train(frame, none)).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and {r["predicted"] for r in got} == {1}
    one = spark.createDataFrame([(k, 1, 0) for k in range(9)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in quality.score(frame, quality.train(frame, one)).collect())
    assert quality.score(frame.limit(0), quality.train(frame.limit(0), one)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert len(rows) > 30 and right >= 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(docs, model).where("predicted = 1").count()
