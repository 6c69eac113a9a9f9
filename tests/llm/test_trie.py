"""Conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from callsight.llm import queries, trie

TURNS = "conv_id long, turn long, role string, text string, digest string, path string"


def rebuilt(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = dict.fromkeys(nodes, 0)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        worth = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += worth
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in nodes.items())


def found(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "bb", "é", "", None]
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # some bases are missing
        length = rng.choice([1, 2, 3, 5, 9, 12])
        start = [("user", "same start"), ("assistant", "same answer")] if c % 3 else []
        turns = (start + [(rng.choice(["user", "assistant", None]), rng.choice(words)) for _ in range(length)])[:length]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(n + 5 * k, t, "user", f"turn {t}") for k in range(60) for t in range(4)]  # whole copies
    rows += [(1000, t, "user", str(t)) for t in range(150)] + [(1001, None, "user", "first"), (1001, 0, "user", "then"), (1001, 0, "user", "then")]
    rows += [(None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, turns", [(4096, 1 << 16), (7, 1 << 16), (1, 1 << 16), (50, 40)])
def test_against_brute_force(spark, monkeypatch, tmp_path, block, turns):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "BLOCK_TURNS", turns)
    rows = rows_of(block)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns[:2] == ["conv_id", "depth"]
    assert found(got) == brute(rebuilt(rows))


def test_small_and_empty_tables(spark, tmp_path):
    for k, rows in enumerate([[], [(7, 0, None, None)], [(1, 0, "user", "only"), (2, 0, "user", "only")], [(6, 0, "a", "b")] * 3]):
        spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        assert found(queries.op13_prefix_trie(spark, f"{tmp_path}/{k}")) == brute(rebuilt(rows))


def test_range_minimum():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 3, 8, 33):
        values = rng.integers(-1, 4, n)
        table = trie.RangeMinimum(values)
        pairs = np.array([(a, b) for a in range(n) for b in range(a, n)])
        assert table.minimum(pairs[:, 0], pairs[:, 1]).tolist() == [values[a:b + 1].min() for a, b in pairs]
        for least in range(4):
            at = np.arange(n)
            left, right = table.left(at, np.full(n, least)), table.right(at, np.full(n, least))
            for k in range(n):
                assert left[k] == next(i for i in range(k, -1, -1) if i == 0 or values[i] < least)
                assert right[k] == next(i for i in range(k, n) if i == n - 1 or values[i + 1] < least)
