"""Retrieval against exhaustive scoring, and verified hits of planted passages."""

import random

import numpy as np
import pyarrow as pa

from callsight.llm import decontaminate as d

RNG = random.Random(5)
COMMON = [f"c{k}" for k in range(15)]
RARE = [f"r{k}" for k in range(900)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(COMMON if rng.random() < 0.5 else RARE) for _ in range(n))


def items(n=70):
    return [sentence(RNG.randrange(8, 40)) + ". " + sentence(RNG.randrange(3, 12)) + "." for _ in range(n)]


def exhaustive(index, terms, threshold):
    scores = np.zeros(len(index.ids))
    for t in terms:
        for k in range(index.at[t], index.at[t + 1]):
            scores[index.items[k]] += index.impact[k]
    return {i: s for i, s in enumerate(scores.tolist()) if s >= threshold}


def test_wand_finds_what_exhaustive_scoring_finds():
    texts = items()
    index = d.build_index(list(range(len(texts))), texts)
    for trial in range(200):
        rng = random.Random(trial)
        words = rng.choice(texts).lower().replace(".", "").split() + sentence(30, rng).split()
        rng.shuffle(words)
        hashes = d.plain_words(pa.array([" ".join(words)]))[0]
        place = np.searchsorted(index.terms, hashes).clip(max=len(index.terms) - 1)
        terms = np.unique(place[index.terms[place] == hashes])
        threshold = rng.choice([0.2, 0.4, 0.7, 0.95])
        want = exhaustive(index, terms, threshold)
        got = dict(d.wand(index, terms, threshold))
        assert got.keys() == {i for i in want if want[i] > threshold + 1e-9} | {i for i in got if abs(want.get(i, 0) - threshold) <= 1e-9}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
        # the batch's bound never loses a hit at the index's own threshold
        reach = np.zeros(index.block_need.shape[1])
        for t in terms[index.rare[terms]]:
            reach += index.block_need[t]
        for i in exhaustive(index, terms, index.threshold):
            assert reach[i // d.ITEMS_PER_BLOCK] >= 0.9999


def brute(texts, docs, overlap=0.8):
    """Items whose question and answer both lie in a document, by plain sets of runs over whole documents."""
    out = set()
    for i, t in docs:
        words = d.plain_words(pa.array([t], pa.string()))[0]
        for k, item in enumerate(texts):
            shares = []
            for part in d.question_and_answer(item or ""):
                w = d.plain_words(pa.array([part]))[0]
                n = min(5, len(w))
                runs = set(d.runs(w, n).tolist())
                held = set(d.runs(words, n).tolist())
                shares.append(len(runs & held) / len(runs) if runs else None)
            if any(s is not None for s in shares) and all(s is None or s >= overlap for s in shares):
                out.add((i, k))
    return out


def planted(texts):
    rows = []
    for k in range(150):
        body = sentence(RNG.randrange(0, 300)).split()
        if k % 3 == 0:
            at = RNG.randrange(len(body) + 1)
            item = RNG.choice(texts)
            item = item.upper().replace(" ", "\n") if k % 2 else item
            body[at:at] = [item]
        rows.append((k, " ".join(body)))
    half = texts[3].split()
    rows += [(500, " ".join(half[:len(half) // 2])), (501, texts[1] + " " + texts[2]), (502, None), (503, ""), (504, "...")]
    return rows


def test_hits_are_those_of_brute_force(spark, docs):
    texts = items(40)
    rows = planted(texts)
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want = brute(texts, rows)
    assert len(want) > 40
    for size in (8 << 20, 2000):  # one block of items, and several
        got = d.contaminated(docs(rows), bench, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    frame = docs(rows)
    clean = d.clean(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({i for i, _ in rows} - {i for i, _ in want})


def test_odd_items_and_tables(spark, docs):
    kind = "item_id long, text string"
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (None, "word")]
    assert d.contaminated(docs(rows), spark.createDataFrame([], kind)).count() == 0
    bench = spark.createDataFrame([(7, None), (8, ""), (9, "Alpha, beta gamma delta epsilon zeta. Eta theta."), (9, "Alpha, beta gamma delta epsilon zeta. Eta theta.")], kind)
    got = d.contaminated(docs(rows), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 9)] * 4
    assert d.contaminated(docs([]), bench).count() == 0
