"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document is cut into full windows of ``capacity`` tokens and a rest. The rests are dealt by
hash into lots of bounded size, and each lot is partitioned on its own: all its pieces begin as
partial partitions, and the two with the largest spread are merged again and again, the fullest
window of one with the emptiest of the other, until one partition with near-equal windows is
left. Where a window exceeds the capacity, the lot gets more windows and is partitioned again. Pieces of a few
tokens are partitioned as bundles. A lot that would leave more than ``SLACK`` of its windows empty has its rests cut,
at multiples of an ever smaller limit, until it does not.

Defined cases: null and empty texts are the end id alone; repeated rows and ids are packed each;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .tokens import END_ID, SLICE, encoder
from .words import slices

CAPACITY = 4096
#: tokens in a lot, on average; a lot is one group of as many rows at most, and of a 16th as many parts to partition
LOT_TOKENS = 1 << 19
#: pieces of fewer tokens are partitioned in bundles of as many
BUNDLE = 32
#: padding by which a lot's rests are cut, and the limits that are tried, as shares of the capacity
SLACK, LIMITS = 0.015, (1, 2, 4, 8)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long, begin long"
#: checks of a rest's parts for each limit, one limit after the other
PARTS = ", crcs array<long>"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """A window of each size, by largest differencing first; window sums come out near equal."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    merges = []  # (first, second, order of the merged windows)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heap[0]
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable").astype(np.int32)
        sums = sums[order]
        sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), n + len(merges), sums))
        merges.append((first, second, order))
    label = {n + len(merges) - 1: np.arange(windows)} if merges else {0: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for at in range(len(merges) - 1, -1, -1):
        first, second, order = merges[at]
        mine = label.pop(n + at)
        for child, place in ((first, order), (second, windows - 1 - order)):
            theirs = np.empty(windows, np.int64)
            theirs[place] = mine
            if child < n:
                out[child] = theirs[0]
            else:
                label[child] = theirs
    return out


def _bundled(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bundle of each size: small ones share one of at most ``BUNDLE`` tokens, others are alone."""
    most = min(BUNDLE, capacity)
    small = np.flatnonzero(sizes * 2 <= most)
    out = np.empty(len(sizes), np.int64)
    large = np.setdiff1d(np.arange(len(sizes)), small, assume_unique=True)
    out[large] = np.arange(len(large))
    now, held = len(large) - 1, most + 1
    for i, size in zip(small.tolist(), sizes[small].tolist()):
        if held + size > most:
            now, held = now + 1, 0
        held += size
        out[i] = now
    return out


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A window of each size such that no window exceeds the capacity; no size may exceed it either."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return sizes
    bundle = _bundled(sizes, capacity)
    sizes = np.bincount(bundle, sizes).astype(np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        of = differencing(sizes, windows)
        over = np.bincount(of, sizes, minlength=windows) - capacity
        if over.max() <= 0:
            return of[bundle]
        windows += max(1, int(over[over > 0].sum() // (4 * capacity)))


def limits(capacity: int) -> list[int]:
    """Lengths at whose multiples rests may be cut; the first leaves them whole."""
    return [max(1, capacity // k) for k in LIMITS if capacity // k or k == 1]


def _part_checks(data: memoryview, begin: np.ndarray, length: np.ndarray, capacity: int) -> pa.Array:
    """For each rest, the checks of its parts under each limit that cuts it."""
    out = []
    for a, n in zip(begin.tolist(), length.tolist()):
        out.append([zlib.crc32(data[a + 4 * k:a + 4 * min(k + m, n)]) for m in limits(capacity)[1:] if m < n < capacity for k in range(0, n, m)])
    return pa.array(out, pa.list_(pa.int64()))


def _cut_rests(lot: pd.DataFrame, limit: int, capacity: int) -> pd.DataFrame:
    """The rests of a lot in parts of at most ``limit``."""
    if limit >= capacity:
        return lot.drop(columns="crcs")
    length = lot["length"].to_numpy()
    parts = -(-length // limit)
    of = np.repeat(np.arange(len(lot)), parts)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * limit
    out = lot.drop(columns="crcs").iloc[of].copy()
    before = np.zeros(len(lot), np.int64)  # where a rest's checks of this limit begin
    for m in limits(capacity)[1:]:
        if m == limit:
            break
        before += np.where(m < length, -(-length // m), 0)
    checks = lot["crcs"].to_numpy()
    whole = lot["ids_crc32"].to_numpy()
    out["ids_crc32"] = [int(checks[i][before[i] + k]) if parts[i] > 1 else int(whole[i]) for i, k in zip(of.tolist(), (at // limit).tolist())]
    out["start"] = out["start"].to_numpy() + at
    out["begin"] = out["begin"].to_numpy() + at
    out["length"] = np.minimum(length[of] - at, limit)
    return out


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids (end id included): PIECES and PARTS, and the ids themselves when asked for."""
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        tokens = encoder(vocabulary)
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                ids, at = tokens.documents(texts)
                size = np.diff(at)
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), parts)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = nth * capacity
                length = np.minimum(size[doc] - start, capacity)
                data, begin = memoryview(ids.astype("<u4").tobytes()), (at[doc] + start) * 4
                stop = begin + length * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]
                columns = [batch.column(0).take(pa.array(first + doc)), pa.array(start), pa.array(length),
                           pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(row + np.arange(len(doc))),
                           pa.array(np.zeros(len(doc), np.int64)), _part_checks(data, begin, length, capacity)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", "begin", "crcs"]
                if with_ids:
                    columns.append(pa.array([bytes(data[a:b]) for a, b in zip(begin.tolist(), stop.tolist())], pa.binary()))
                    names.append("ids")
                row += len(doc)
                yield pa.record_batch(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + PARTS + (", ids binary" if with_ids else ""))


def assign(pieces: DataFrame, capacity: int = CAPACITY, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """sequence_id and offset of every piece, of which rests may come in several parts (from ``begin`` on).
    pieces: a written table with PIECES and PARTS."""
    rest = pieces.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    lots = max(1, -(-total // lot_tokens))

    def place(lot: pd.DataFrame) -> pd.DataFrame:
        lot, best = lot.sort_values(["length", "piece"], ascending=[False, True], kind="stable"), None
        least = -(-int(lot["length"].sum()) // capacity)
        for limit in limits(capacity):
            tried = _cut_rests(lot, limit, capacity)
            window = pack_sizes(tried["length"].to_numpy(), capacity)
            used = int(window.max()) + 1
            if best is None or used < best[0]:
                best = used, tried, window
            if used <= max(least, int(least * (1 + SLACK))):
                break
        _, lot, window = best
        lot = lot.assign(sequence_id=(lot["lot"].to_numpy() << 24) + window)
        lot["offset"] = lot.groupby("sequence_id")["length"].cumsum() - lot["length"]
        return lot.drop(columns="lot")

    packed = (rest.withColumn("lot", F.pmod(F.xxhash64("piece", "doc_id"), F.lit(lots))).groupBy("lot")
              .applyInPandas(place, PIECES + ", sequence_id long, offset long"))
    whole = pieces.where(F.col("length") >= capacity).drop("crcs").withColumns(
        {"sequence_id": F.col("piece") + F.lit(1 << 60), "offset": F.lit(0).cast("long")})
    return whole.unionByName(packed)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stage(cut(docs, capacity, vocabulary), "pack-pieces")
    return assign(pieces, capacity).drop("piece", "begin")


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed windows themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit, in offset order)."""
    pieces = stage(cut(docs, capacity, vocabulary, with_ids=True), "pack-pieces")
    placed = assign(pieces.drop("ids"), capacity).select("piece", "begin", "sequence_id", "offset", "length")
    held = F.substring("ids", (F.col("begin") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids")
    parts = placed.join(pieces.select("piece", "ids"), "piece").groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", held))).alias("parts"))
    return parts.select("sequence_id", "n_tokens",
                        F.expr("aggregate(parts, X'', (x, p) -> concat(x, p.ids))").alias("ids"))


__all__ = ["CAPACITY", "END_ID", "assign", "cut", "differencing", "pack", "pack_sizes", "sequences"]
