"""The id filter changes nothing about a join's result."""

import pytest

from callsight.llm import probe, staging


@pytest.mark.parametrize("bits", [64, 1 << 20])  # a full filter, and one that rules nearly all out
def test_without_and_among(spark, monkeypatch, bits):
    monkeypatch.setattr(probe, "MIN_BITS", bits)
    monkeypatch.setattr(probe, "MAX_BITS", bits)
    rows = spark.createDataFrame([(k, str(k)) for k in range(3000)] + [(7, "again"), (None, "none"), (-5, "minus")], "doc_id long, _listed string")
    ids = staging.stage(spark.createDataFrame([(k,) for k in range(0, 3000, 10)] + [(None,), (7,), (7,), (-5,)], "x long"), "t-ids")
    listed = {*range(0, 3000, 10), 7, -5}
    for got, want in ((probe.without(rows, "doc_id", ids), lambda i: i is None or i not in listed),
                      (probe.among(rows, "doc_id", ids), lambda i: i is not None and i in listed)):
        assert got.columns == rows.columns
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in rows.collect() if want(r["doc_id"]))
    nothing = staging.stage(ids.limit(0), "t-ids")
    assert probe.without(rows, "doc_id", nothing).count() == 3003 and probe.among(rows, "doc_id", nothing).count() == 0
