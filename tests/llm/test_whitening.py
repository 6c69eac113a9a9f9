"""Whitening against a dense eigendecomposition, and the singular solver on hard matrices."""

import math

import numpy as np
import pytest

from callsight.llm import singular, whitening

VECTORS = "vec_id long, embedding array<double>, label int, n long, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)


def brute(rows):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    size = max((sum(len(w) == len(v) for _, w in usable), len(v)) for _, v in usable)[1]
    usable = [(i, v) for i, v in usable if len(v) == size]
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in usable]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[a - s / n for a, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in usable], n, deviation, centred, values[::-1], vectors[:, ::-1]


def test_against_dense_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 3)
    monkeypatch.setattr(whitening, "ROWS", 50)
    rng = np.random.Generator(np.random.PCG64(12))
    mix = rng.normal(size=(40, 40)) * np.linspace(0.2, 1, 40)
    rows = [(k, v) for k, v in enumerate((rng.normal(size=(700, 40)) @ mix).tolist())]
    rows += [(7, rows[7][1])] * 30 + [(None, rows[8][1]), (900, None), (901, []), (902, [1.0]), (903, [math.nan] * 40), (904, [math.inf] * 40),
                                      (905, [None] * 40), (906, [0.0] * 40), (907, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows).repartition(11)).toPandas()
    ids, n, deviation, centred, values, vectors = brute(rows)
    assert len(got) == 32 * n and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 33))
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values[:32] / values.sum(), rtol=1e-10)
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    for c in range(32):
        mine = got[got["component"] == c + 1].sort_values(["deviation", "whitened"])
        theirs = sorted(zip(deviation, want[:, c]), key=lambda p: p[0])
        a, b = np.array(sorted(np.abs(mine["whitened"]))), np.array(sorted(abs(w) for _, w in theirs))
        assert np.allclose(a, b, atol=1e-8)
    whitened = got[got["vec_id"] == 3].sort_values("component")["whitened"].to_numpy()
    assert np.allclose(np.abs(whitened), np.abs(want[ids.index(3)]), atol=1e-8)


def test_defined_cases(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
    # one direction only, and entries far beyond a long
    got = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 1.0])])).collect()
    assert [r["component"] for r in got] == [1, 1, 1] and got[0]["explained"] == 1.0
    assert sorted(r["deviation"] for r in got) == [0, 96 * 96, 96 * 96]
    got = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3e9, 2.0])])).collect()
    assert {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4


def matrices():
    rng = np.random.Generator(np.random.PCG64(5))
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    p, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    yield from (rng.normal(size=(n, n)) for n in (1, 2, 3, 17, 64))
    yield np.eye(9)
    yield np.diag([1.0, 1, 2, 2, 3])
    yield np.diag(np.abs(np.arange(-10.0, 11.0))) + np.diag(np.ones(20), 1)
    for values in ([1.0] * 20 + [2.0] * 20, 1 + 1e-9 * np.arange(40), 1 + 1e-13 * np.arange(40), 0.5 ** np.arange(40)):
        yield q @ np.diag(values) @ p


@pytest.mark.parametrize("k", range(12))
def test_singular_solver(k):
    a = list(matrices())[k]
    values, vectors = singular.right_singular(a)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    real = want > want[0] * 1e-20
    assert np.allclose(values[real], want[real], rtol=1e-8, atol=want[0] * 1e-14)
    v = vectors[:, real]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-9
    assert np.abs(a.T @ (a @ v) - v * values[real]).max() < 1e-9 * want[0]


def test_small_values_keep_their_digits():
    diagonal, above = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(11.0)
    from decimal import Decimal, getcontext
    getcontext().prec = 80
    found = singular.dqds(diagonal, above)
    product = Decimal(1)
    for x in found:
        product *= Decimal(float(x))
    exact = Decimal(1)
    for x in diagonal:
        exact *= Decimal(float(x)) ** 2
    assert abs(product / exact - 1) < Decimal("1e-12")
