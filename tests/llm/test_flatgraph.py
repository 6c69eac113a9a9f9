"""Near vectors against all pairs, with shards, clusters and blocks of any size."""

import math

import numpy as np
import pytest

from callsight.llm import flatgraph

VECTORS = "vec_id long, embedding array<double>, id long, unit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)


def brute(rows, least=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v) / max(map(abs, v))
            good[k] = x / np.linalg.norm(x)
    links = {k: [j for j, y in good.items() if j != k and len(x) == len(y) and x @ y >= least] for k, x in good.items()}
    component = {}
    for k in good:
        if k not in component:
            todo, seen = [k], {k}
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                component[j] = min(rows[m][0] for m in seen)
    return sorted(((i, len(links.get(k, ())), component.get(k, i), i is None or component.get(k, i) == i) for k, (i, _) in enumerate(rows)), key=str)


def found(got):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)


def rows_of(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.normal(size=(600, 24))
    rows = list(enumerate(base.tolist()))
    hot = rng.normal(size=24)
    rows += [(1000 + k, (hot + 0.08 * rng.normal(size=24)).tolist()) for k in range(300)]  # one large group
    rows += [(2000 + k, (2 * base[k] + 0.3 * rng.normal(size=24)).tolist()) for k in range(80)]  # pairs
    chain = rng.normal(size=24)
    for k in range(40):  # a component whose ends are far apart
        chain = chain + 0.3 * rng.normal(size=24)
        rows.append((3000 + k, chain.tolist()))
    rows += [(4000 + k, base[5].tolist()) for k in range(50)] + [(7, base[7].tolist()), (8, base[300].tolist())]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [math.nan] * 24), (5004, [None] * 24), (5005, [1e200] * 24), (5006, [1e-200] * 24),
             (None, base[9].tolist()), (5007, [1.0, 2.0]), (5008, [1.0, 2.1]), (5009, [-0.0, 1.0]), (5010, [0.0, 1.0])]
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("shard, aim, rows", [(4096, 2048, 1024), (60, 200, 50)])
def test_against_all_pairs(spark, monkeypatch, shard, aim, rows):
    monkeypatch.setattr(flatgraph, "SHARD", shard)
    monkeypatch.setattr(flatgraph, "AIM", aim)
    monkeypatch.setattr(flatgraph, "_ROWS", rows)
    data = rows_of(11)
    got = flatgraph.near_vectors(frame(spark, data)).collect()
    assert got[0]["audited_recall"] >= 0.9
    want = brute(data)
    mine = found(got)
    assert len(mine) == len(want)
    assert sum(n for _, n, _, _ in mine) >= 0.98 * sum(n for _, n, _, _ in want)
    over = [(a, b) for a, b in zip(mine, want) if a[1] > b[1]]
    assert not over
    assert sum(a[2:] == b[2:] for a, b in zip(mine, want)) >= 0.99 * len(want)
    if aim == 2048:
        assert mine == want


def test_no_rows_and_no_links(spark):
    assert flatgraph.near_vectors(frame(spark, [])).collect() == []
    rows = [(k, v) for k, v in enumerate(np.eye(5).tolist())]
    assert found(flatgraph.near_vectors(frame(spark, rows)).collect()) == brute(rows)


def test_every_vector_is_reached_from_the_medoid():
    rng = np.random.Generator(np.random.PCG64(3))
    far = np.concatenate([rng.normal(size=(300, 16)), 50 + rng.normal(size=(300, 16)), rng.normal(size=(3, 16)) - 80])
    x = (far / np.linalg.norm(far, axis=1)[:, None]).astype(np.float32)
    lists, medoid = flatgraph.build(x)
    seen, todo = {medoid}, [medoid]
    while todo:
        for v in lists[todo.pop()].tolist():
            if v not in seen:
                seen.add(v)
                todo.append(v)
    assert len(seen) == len(x)
    degrees = [len(v) for v in lists]
    assert np.mean(degrees) <= 2 * flatgraph.DEGREE


def test_search_expands_over_a_whole_range():
    rng = np.random.Generator(np.random.PCG64(4))
    x = np.concatenate([rng.normal(size=(400, 16)), rng.normal(size=16) + 0.1 * rng.normal(size=(200, 16))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    lists, medoid = flatgraph.build(x)
    neighbours = flatgraph._padded(lists, max(map(len, lists)), len(x))
    hits = flatgraph.search(x, neighbours, x[390:410], np.full((20, 1), medoid), 0.8)
    want = x[390:410] @ x.T >= 0.8
    assert (hits & ~want).sum() == 0 and hits.sum() >= 0.99 * want.sum()
