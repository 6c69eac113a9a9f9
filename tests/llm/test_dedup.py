"""Exact and near dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from callsight.llm import components, exact, near

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        keep = next((i for i in ids if i is not None), None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def exact_rows():
    rng = random.Random(1)
    rows = [(i, f"Text {i}") for i in range(40)] + [(100 + i, "HOT é É") for i in range(60)] + [(200 + i, "hot é É") for i in range(3)]
    rows += [(300, None), (301, ""), (302, " "), (303, None), (None, "lone"), (None, "pair"), (304, "pair"), (5, "Text 5"), (5, "Text 5")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("top", [1, 512])
def test_exact_mark(docs, top):
    rows = exact_rows()
    got = exact.mark(docs(rows), top=top, tracked=1024).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_exact(rows)


def test_exact_deduplicate_keeps_columns(docs):
    rows = exact_rows()
    frame = docs(rows)
    got = exact.deduplicate(frame)
    assert got.columns == frame.columns
    want = sorted([(i, (t or "").lower()) for (i, k, n, kept, s) in brute_exact(rows) if kept
                   for t in {(t or "").translate(UPPER) for j, t in rows if j == i and hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest() == s}], key=str)
    assert sorted([(r["doc_id"], (r["text"] or "").lower()) for r in got.collect()], key=str) == want


def test_exact_empty(docs):
    assert exact.mark(docs([])).count() == 0
    assert exact.deduplicate(docs([])).count() == 0


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def near_rows(seed=0, base=12, copies=18):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(base):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.randrange(1, copies)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy) if rng.random() < 0.8 else "  ".join(copy).upper())
    rows += [None, "", " \n", "a b", "A  b", "one", "a b c d e"]
    ids = list(range(10, 10 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("crowd,percent", [(24, 85), (3, 85), (24, 80)])
def test_near_against_all_pairs(docs, crowd, percent):
    rows = near_rows(crowd)
    got = near.near_duplicates(docs(rows), percent, crowd=crowd).collect()
    assert sorted(tuple(r) for r in got) == brute_near(rows, percent)


def test_near_large_group_of_equal_and_near_texts(docs):
    rng = random.Random(7)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(base)) for k in range(200, 500)]
    for k in range(500, 900):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(copy)))
    got = near.near_duplicates(docs(rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_near(rows, 85)


def crowd_rows(seed=3, n=1100, pairs=60):
    """Texts around one passage at similarity 0.7 to 0.8 to each other, holding isolated pairs at 0.81 and 0.86."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(200)]
    fresh = lambda k: [f"u{rng.randrange(10 ** 9)}" for _ in range(k)]
    texts = [passage + fresh(rng.choice([28, 32, 36])) for _ in range(n - 2 * pairs)]
    for k in range(pairs):
        same = fresh(8 if k % 2 else 15)
        texts += [passage + same + fresh(32 - len(same)) for _ in range(2)]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("percent,dropped", [(80, 60), (85, 30)])
def test_near_pairs_inside_a_crowd(docs, percent, dropped):
    rows = crowd_rows()
    sets = [shingle_set(t) for _, t in rows]
    number = {}
    for x in sets:
        for shingle in x:
            number.setdefault(shingle, []).append(0)
    number = {shingle: k for k, shingle in enumerate(s for s, held in number.items() if len(held) > 1)}
    holds = np.zeros((len(sets), len(number)), np.float32)
    for k, x in enumerate(sets):
        holds[k, [number[s] for s in x if s in number]] = 1
    n = np.array([len(x) for x in sets])
    both = np.rint(holds @ holds.T).astype(int)
    alike = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)
    first = {int(b): int(a) for a, b in np.argwhere(alike)}             # isolated pairs: no chains
    assert len(first) == dropped and not set(first) & set(first.values())
    want = [(k, int(n[k]), first.get(k, k), k not in first) for k in range(len(rows))]
    assert sorted(tuple(r) for r in near.near_duplicates(docs(rows), percent).collect()) == want


def test_near_trees_follow_the_similarity():
    assert (near.trees_for(85), near.trees_for(80), near.trees_for(100)) == (16, 22, 16)
    assert all((1 - (p / 100) ** 4) ** near.trees_for(p) <= near.MISSED for p in range(50, 101))


def test_near_defined_cases(docs):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)]
    got = sorted([tuple(r) for r in near.near_duplicates(docs(rows)).collect()], key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False), (2, 0, 2, True)], key=str)
    kept = near.deduplicate(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]
    assert near.near_duplicates(docs([])).count() == 0


def test_rows_of_one_id_with_different_texts_stand_apart(docs):
    """Doc 7 holds a copy of doc 1 in one row and a text of its own in another; doc 5 is there twice."""
    rows = [(1, "a b c d e f g h"), (7, "A b c d e f g h"), (7, "only here and nowhere else at all"), (5, "k l m n o p q"), (5, "k l m n o p q"),
            (9, "k l m n o p q"), (2, "x y"), (2, "x y z"), (2, None), (2, None)]
    marks = {(r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs(rows)).collect()}
    assert marks >= {(7, 1, False), (7, 7, True), (5, 5, True), (9, 5, False), (1, 1, True)}
    kept = near.deduplicate(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([
        (1, "a b c d e f g h"), (7, "only here and nowhere else at all"), (5, "k l m n o p q"), (2, "x y"), (2, "x y z"), (2, None), (2, None)], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    random.Random(2).shuffle(chain)
    star = [(1000, k) for k in range(1001, 1100)]
    got = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1100)}
