"""Shards: near-equal bytes, whole groups, gapless slots."""

import random
import zlib

from callsight.llm import sharding


def rows():
    rng = random.Random(3)
    out = [(k, "w" * rng.randrange(1, 400) + f" {k}") for k in range(1500)]
    out += [(2000 + k, "copied text") for k in range(40)] + [(3000 + k, "HOT " * 20) for k in range(3000)]
    out += [(None, "no id"), (7000, None), (7001, ""), (1, "again"), (1, "again")]
    rng.shuffle(out)
    return out


def test_law_of_bytes(docs):
    data = rows()
    got = sharding.shard(docs(data)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    sizes = [0] * 16
    slots = [[] for _ in range(16)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 16 + 800
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # equal texts stay together unless they alone are too much for a shard
    for text in ("copied text", "again"):
        assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(text.encode())}) == 1
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(("HOT " * 20).encode())}) > 4


def test_other_counts_chunks_and_dimensions(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 10)
    got = sharding.shard(docs([(k, "x" * (k % 97)) for k in range(2000)]), shards=5, dimensions=("doc_id", "n_chars")).collect()
    sizes, slots = [0] * 5, [[] for _ in range(5)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sizes) - min(sizes) <= 0.1 * sum(sizes) / 5
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_tiny_tables(docs):
    assert sharding.shard(docs([])).count() == 0
    got = sharding.shard(docs([(1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted(r["size"] for r in got) == [1, 2, 2]
    assert all(0 <= r["shard"] < 16 for r in got)
