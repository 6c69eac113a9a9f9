"""Packing and the Huffman dataset: exact round trips against the library's ids."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from callsight.llm import huffman, packing, staging
from callsight.llm.tokens import PieceEncoder


def texts(n=120):
    rng = random.Random(11)
    rows = [(k * 3, " ".join(rng.choice(["the", "of", "Anlyre,", "été.", "x!!", f"w{rng.randrange(999)}"]) for _ in range(rng.choice([0, 3, 40, 300]))))
            for k in range(n)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 9000), (5, "tie one"), (5, "tie two"), (5, "tie two"), (None, "no id")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder()


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity,lot", [(64, 500), (4096, 1 << 19)])
def test_packing_places_every_id_once(spark, docs, encoder, capacity, lot):
    rows = texts()
    pieces = staging.stage(packing.cut(docs(rows), capacity, with_ids=True), "t")
    got = packing.assign(pieces.drop("ids"), capacity, lot).join(pieces.select("piece", "ids"), "piece").collect()
    # each document's pieces are its ids
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")[r["begin"]:r["begin"] + r["length"]]  # a rest may come in several parts
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and 0 < r["length"] <= capacity
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids.tolist()))
    want = {}
    for i, t in rows:
        ids = direct(encoder, t)
        want.setdefault((i, len(ids)), []).append(ids)
    assert by_doc.keys() == want.keys()
    for k, parts in by_doc.items():
        assert all(any(ids[a:a + len(x)] == x for ids in want[k]) for a, x in parts)
        assert sorted(p for a, x in parts for p in range(a, a + len(x))) == sorted(p for ids in want[k] for p in range(len(ids)))
    # sequences are full or close to it, and offsets leave no gap
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1.15 * total / capacity + 2


def test_sequences_hold_the_ids(docs, encoder):
    rows = [(1, "a b c"), (2, None), (3, "the of " * 60)]
    got = packing.sequences(docs(rows), 50).collect()
    assert sorted(x for r in got for x in np.frombuffer(r["ids"], "<u4").tolist()) == sorted(x for _, t in rows for x in direct(encoder, t))
    assert all(r["n_tokens"] * 4 == len(r["ids"]) <= 200 for r in got)


def test_packing_nothing(docs):
    assert packing.pack(docs([])).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 600)
    sums = np.bincount(packing.differencing(sizes, 70), sizes, 70)
    assert sums.max() - sums.min() <= 0.005 * sums.mean() and sums.sum() == sizes.sum()
    assert packing.pack_sizes(np.array([], int)).tolist() == []
    of = packing.pack_sizes(np.array([3000] * 10), 4096)  # no two fit together
    assert sorted(of.tolist()) == list(range(10))


@pytest.mark.parametrize("bits,part_docs,block", [(16, 20, 300), (9, 20_000, 1 << 18)])
def test_huffman_round_trip(spark, docs, encoder, monkeypatch, bits, part_docs, block):
    monkeypatch.setattr(huffman, "PART_DOCS", part_docs)
    monkeypatch.setattr(huffman, "BLOCK_IDS", block)
    rows = texts()
    path = f"{staging.shared_dir(spark)}/t-huffman-{bits}-{random.random()}"
    huffman.write(docs(rows), path, max_bits=bits)
    got = huffman.read(spark, path, with_ids=True).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r["start"])
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in order]
    assert keys == sorted(keys)
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["n_tokens"]
    want = sorted(((-1 if i is None else i), direct(encoder, t)) for i, t in rows)
    assert sorted((k, np.frombuffer(r["ids"], "<u4").tolist()) for k, r in zip(keys, order)) == want


def test_huffman_of_nothing(docs):
    assert huffman.round_trip(docs([])).count() == 0


def test_code_lengths_are_the_best_under_the_limit():
    import heapq

    rng = np.random.default_rng(0)
    for n in (2, 3, 7, 500):
        counts = rng.integers(1, 1000, n)
        heap, best = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            best += x
            heapq.heappush(heap, x)
        bits = huffman.code_lengths(counts, 40)
        assert int((counts * bits).sum()) == best
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377])
    for limit in (4, 6, 9):
        bits = huffman.code_lengths(fibonacci, limit)
        assert bits.max() <= limit and sum(2.0 ** -int(b) for b in bits) <= 1
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]


def test_decoding_begins_at_any_checkpoint():
    rng = np.random.default_rng(4)
    ids = rng.choice(1000, 5000, p=rng.dirichlet(np.full(1000, 0.1))).astype(np.uint32)
    bits = huffman.code_lengths(np.bincount(ids, minlength=1000))
    at = np.array([0, 1200, 1200, 1201, 5000])
    data, byte_at, within = huffman.encode(ids, at, huffman.canonical(bits), bits)
    table = huffman.decode_table(bits)
    for doc in (0, 2, 3):
        for first in range(at[doc], at[doc + 1], huffman.STRIDE):
            n = min(huffman.STRIDE, at[doc + 1] - first)
            got = huffman.decode(np.frombuffer(data, np.uint8), np.array([within[first] + 8 * byte_at[doc]]), np.array([n]), table)
            assert got.tolist() == ids[first:first + n].tolist()


@pytest.mark.parametrize("low, high", [(2100, 2100), (2049, 3000), (1366, 2000), (1, 40), (1, 4095)])
def test_rests_are_cut_where_windows_would_stay_empty(spark, low, high):
    rng = random.Random(low)
    ids = {k: np.array([rng.randrange(40000) for _ in range(rng.randint(low, high))], "<u4") for k in range(250)}
    rows = []
    for k, v in ids.items():
        data = memoryview(v.tobytes())
        checks = packing._part_checks(data, np.array([0]), np.array([len(v)]), 4096)[0].as_py()
        rows.append((k, 0, len(v), zlib.crc32(data), len(v), k, 0, checks))
    pieces = spark.createDataFrame(rows, packing.PIECES + packing.PARTS)
    got = packing.assign(pieces).collect()
    total = sum(map(len, ids.values()))
    windows, seen = {}, {}
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans, most in [(s, 4096) for s in windows.values()] + [(s, None) for s in seen.values()]:
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert most is None or at <= most
    assert sum(n for s in seen.values() for _, n in s) == total
    assert len(windows) * 4096 <= 1.02 * total + 4096


def test_very_many_tiny_pieces_take_little_memory():
    import tracemalloc
    tracemalloc.start()
    of = packing.pack_sizes(np.ones(500_000, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(of).max() <= 4096 and of.max() + 1 <= 124 and peak < 250 << 20


def test_rows_of_one_id_keep_their_order(spark, docs, encoder, monkeypatch):
    """Many rows of one id may lie in several parts; every row starts where the one before it ends."""
    monkeypatch.setattr(huffman, "PART_DOCS", 10)
    rows = [(7, f"the {k} of") for k in range(60)] + [(None, "x"), (8, None)]
    path = f"{staging.shared_dir(spark)}/t-one-id-{random.random()}"
    huffman.write(docs(rows), path)
    first = huffman.read(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in first] == [None] + [7] * 60 + [8]
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 3
    at = 0
    for r in first:
        assert r["start"] == at
        at += r["n_tokens"]
