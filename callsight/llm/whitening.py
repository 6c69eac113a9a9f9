"""Whitening of embeddings from the singular values of their centred rows.

Every task reduces its centred rows, block by block, to a triangular matrix (QR); the triangles of all tasks
are reduced in the same way, a bounded number at a time, to one of the size of the dimension. Its singular
values and vectors (``singular``) give the variances and the directions; the covariance itself is never made.
What the directions give is measured: means and co-moments of the whitened rows are merged the same way.

Entries are made whole numbers, x = floor(scale * c) + offset, so sums, means and distances are exact.
Defined cases: vectors that are null, empty or hold null or non-finite entries are left out; of vectors of
different lengths, those of the most frequent length (of several, the longest) are kept, the others left out;
entries beyond 2**52 units count as 2**52 units; a direction without variance (to the precision of the
largest) is no component, so equal vectors, or one vector, give no rows; a deviation beyond a long is null;
repeated and null ids give rows each; other columns are ignored; an empty table gives no rows.
A task holds a few matrices of dimension x dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .singular import EPS, right_singular
from .staging import stage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: rows of a block, triangles or moments that one task merges at a time
ROWS, MERGED = 2048, 16
_LIMIT = float(1 << 52)


def whole(column: pa.Array, scale: int = SCALE, offset: int = OFFSET):
    """(row numbers, matrix of whole numbers) of a list column, for each length, without unusable rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (sizes > 0) & (wrong[at[1:]] == wrong[at[:-1]])
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        values = flat if len(rows) * size == len(flat) else flat[at[rows][:, None] + np.arange(size)]
        with np.errstate(over="ignore"):
            units = np.clip(np.floor(values.reshape(-1, size) * scale), -_LIMIT, _LIMIT)
        yield rows, units.astype(np.int64) + offset


class Fit:
    """What the rows have in common: their number, the sums of their entries, and the entries' scale."""

    def __init__(self, n: int, sums: list[int], scale: int, offset: int):
        self.n, self.scale, self.offset = n, scale, offset
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def matrices(self, column: pa.Array):
        """(row numbers, whole numbers less the floor of their mean) of the rows of the kept length."""
        for rows, x in whole(column, self.scale, self.offset):
            if x.shape[1] == len(self.floor):
                yield rows, x - self.floor

    def centred(self, less: np.ndarray) -> np.ndarray:
        return less - self.rest / self.n

    def deviations(self, less: np.ndarray) -> list:
        """Sum of the squares of n * x - S, exactly; None beyond a long."""
        largest = (int(np.abs(less).max(initial=0)) + 1) * self.n
        if largest * largest * less.shape[1] < 1 << 63:
            off = less * self.n - self.rest
            return np.einsum("ij,ij->i", off, off).tolist()
        off = less.astype(object) * self.n - self.rest.astype(object)
        sums = (off * off).sum(1)
        return [s if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> Fit | None:
    """Number and sums of the usable rows of the most frequent length. vectors: one list column."""
    def run(batches):
        found: dict = {}
        for batch in batches:
            for rows, x in whole(batch.column(0), scale, offset):
                n, high, low = found.get(x.shape[1], (0, 0, 0))
                # two halves, so that no sum of many rows leaves a long
                found[x.shape[1]] = n + len(rows), high + (x >> 20).sum(0), low + (x & 0xFFFFF).sum(0)
        for size, (n, high, low) in found.items():
            yield pa.record_batch([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)),
                                   pa.array(high), pa.array(low)], ["size", "dimension", "n", "high", "low"])

    sums = (vectors.mapInArrow(run, "size long, dimension long, n long, high long, low long").groupBy("size", "dimension")
            .agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]))
    best = sums.where("dimension = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not best:
        return None
    rows = sums.where(F.col("size") == best[0]["size"]).orderBy("dimension").collect()
    return Fit(best[0]["n"], [(r["high"] << 20) + r["low"] for r in rows], scale, offset)


def folded(rows: DataFrame, merge) -> bytes:
    """All payloads merged into one, ``MERGED`` at a time in tasks. rows: part (from 0), payload."""
    def run(table: pa.Table) -> pa.Table:
        some = table.sort_by("part")
        return pa.table({"part": some["part"][:1], "payload": pa.array([merge(some["payload"].to_pylist())], pa.binary())})

    kind = "part long, payload binary"
    rows = stage(rows, "folded")
    while rows.count() > MERGED:
        rows = stage(rows.groupBy((F.col("part") / MERGED).cast("long").alias("group")).applyInArrow(run, kind)
                     .select((F.col("part") / MERGED).cast("long").alias("part"), "payload"), "folded")
    return merge([bytes(r["payload"]) for r in rows.orderBy("part").collect()])


def _per_task(make):
    """For mapInArrow: one payload a task, from the batches' only column; none where make gives none."""
    def run(batches):
        payload = make(batch.column(0) for batch in batches)
        if payload is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([payload], pa.binary())],
                                  ["part", "payload"])

    return run


def _triangle(blocks, size: int) -> np.ndarray:
    """The triangle of rows given in blocks."""
    r = np.zeros((0, size))
    for block in blocks:
        for k in range(0, len(block), ROWS):
            r = np.linalg.qr(np.concatenate([r, block[k:k + ROWS]]), mode="r")
    return r


def triangle(vectors: DataFrame, f: Fit) -> np.ndarray:
    """The triangular factor of all centred rows, square."""
    size = len(f.floor)

    def of_rows(columns):
        return _triangle((f.centred(less) for column in columns for _, less in f.matrices(column)), size).tobytes()

    def merge(payloads):
        return _triangle((np.frombuffer(p).reshape(-1, size) for p in payloads), size).tobytes()

    r = np.frombuffer(folded(vectors.mapInArrow(_per_task(of_rows), "part long, payload binary"), merge)).reshape(-1, size)
    return np.concatenate([r, np.zeros((size - len(r), size))])


def _merged(moments):
    """Count, mean and co-moments of rows, from those of their parts."""
    n, mean, products = 0.0, None, None
    for m, other, more in moments:
        if n == 0:
            n, mean, products = m, other, more
        elif m:
            off = other - mean
            products = products + more + np.outer(off, off) * (n * m / (n + m))
            mean, n = mean + off * (m / (n + m)), n + m
    return n, mean, products


def _pack(n, mean, products) -> bytes:
    return np.concatenate([[n], mean, products.ravel()]).tobytes()


def _unpack(payload: bytes, size: int):
    values = np.frombuffer(payload)
    return values[0], values[1:1 + size], values[1 + size:].reshape(size, size)


def identity_error(vectors: DataFrame, f: Fit, directions: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    size = directions.shape[1]

    def of_rows(columns):
        def parts():
            yield 0.0, np.zeros(size), np.zeros((size, size))
            for column in columns:
                for _, less in f.matrices(column):
                    w = f.centred(less) @ directions
                    mean = w.mean(0)
                    w -= mean
                    yield float(len(w)), mean, w.T @ w

        return _pack(*_merged(parts()))

    def merge(payloads):
        return _pack(*_merged(_unpack(p, size) for p in payloads))

    n, _, products = _unpack(folded(vectors.mapInArrow(_per_task(of_rows), "part long, payload binary"), merge), size)
    return float(np.abs(products / n - np.eye(size)).max())


def components(f: Fit, r: np.ndarray, limit: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the whole variance, and directions as columns that whiten centred rows, largest variance first."""
    squares, vectors = right_singular(r)
    real = squares > squares[0] * (len(squares) * EPS) ** 2
    real &= np.arange(len(squares)) < limit
    return squares[real] / squares.sum(), vectors[:, real] / np.sqrt(squares[real] / f.n)


KIND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, limit: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each usable row of vectors (vec_id, embedding) and component."""
    spark, entries = vectors.sparkSession, vectors.select("embedding")
    f = fit(entries, scale, offset)
    if f is None:
        return spark.createDataFrame([], KIND)
    shares, directions = components(f, triangle(entries, f), limit)
    if not len(shares):
        return spark.createDataFrame([], KIND)
    error, k = identity_error(entries, f, directions), len(shares)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for rows, less in f.matrices(batch.column(1)):
                for a in range(0, len(rows), ROWS):
                    some = less[a:a + ROWS]
                    spread = np.repeat(np.arange(len(some)), k)
                    w = f.centred(some) @ directions
                    yield pa.record_batch([
                        ids.take(pa.array(rows[a:a + ROWS][spread])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                        pa.array(np.full(len(spread), f.n, np.int64)), pa.array(f.deviations(some), pa.int64()).take(pa.array(spread)),
                        pa.array(w.ravel()), pa.array(np.tile(shares, len(some))), pa.array(np.full(len(spread), error))],
                        [c.split()[0] for c in KIND.split(", ")])

    return vectors.select("vec_id", "embedding").mapInArrow(run, KIND)
