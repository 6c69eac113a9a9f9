"""Inverted lists: approximate, and certified exact, nearest neighbours without scanning the whole index.

Centroids are fitted on a bounded sample; every row belongs to the list of its nearest centroid, and a list's
radius is its farthest row. A query reads its ``probes`` nearest lists. How many are needed is measured
(``calibrate``) against exact answers. ``exact`` then reads on: by the triangle inequality a list whose centroid is
farther from the query than its radius plus the k-th distance found so far holds nothing closer, and only the
other lists are read, so the answer is that of a full scan, whatever was probed first.

Distances are Euclidean, of unit vectors for the cosine. Stored lists are partition folders (``sources.collections``),
so lists that no query probes are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .topk import RunningTopK, slices
from .vectors import QUERY_BLOCK, dense, distances

#: vectors that centroids are fitted on (about), by number and by bytes; lists at most
SAMPLE, SAMPLE_BYTES, MAX_LISTS = 16_384, 64 << 20, 1024
HITS = "query_id string, doc_id string, distance double"


@dataclass
class Lists:
    """Centroids (rows), radii and sizes of the lists of an index, and its metric."""

    metric: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _scaled(block: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return block
    norm = np.sqrt((block * block).sum(1))
    return block / np.where(norm == 0, 1.0, norm)[:, None]


def _apart(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centroids."""
    square = (block * block).sum(1)[:, None] - 2 * block @ centroids.T + (centroids * centroids).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def fit(index: DataFrame, metric: str = "cosine", lists: int | None = None, rounds: int = 8) -> np.ndarray:
    """Centroids of about the square root of the rows' number of lists, by k-means on a sample chosen by id."""
    rows = index.where("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return np.zeros((1, 1))
    share = min(1.0, min(SAMPLE, max(64, SAMPLE_BYTES // (8 * size))) / n)
    some = rows.where(F.shiftright(F.xxhash64("doc_id"), 1).between(0, int((1 << 62) * share))).orderBy("doc_id").select("vector").toArrow()
    if not len(some):
        some = rows.limit(1).select("vector").toArrow()
    sample = _scaled(dense(some["vector"].combine_chunks(), dim=size), metric)
    k = max(1, min(lists or round(n ** 0.5), MAX_LISTS, len(sample)))
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = np.concatenate([_apart(sample[a:a + 4096], found).argmin(1) for a in range(0, len(sample), 4096)])
        sums, count = np.zeros_like(found), np.bincount(of, minlength=k)
        np.add.at(sums, of, sample)
        found[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return found


def assign(index: DataFrame, centroids: np.ndarray, metric: str = "cosine") -> DataFrame:
    """doc_id, vector, list and apart (the distance to the list's centroid) of every row that has a vector."""
    import pyarrow as pa

    shared = index.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for batch in batches:
            for first, end in slices(batch.num_rows, len(c)):
                some = batch.slice(first, end - first)
                far = _apart(_scaled(dense(some.column(1), dim=c.shape[1]), metric), c)
                near = far.argmin(1)
                yield pa.record_batch([some.column(0), some.column(1), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])],
                                      ["doc_id", "vector", "list", "apart"])

    rows = index.where("vector is not null").select(F.col("doc_id").cast("string").alias("doc_id"),
                                                    F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "doc_id string, vector array<double>, list int, apart double")


def described(assigned: DataFrame, centroids: np.ndarray, metric: str) -> Lists:
    """Radius and size of every list; lists are a bounded number."""
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in assigned.groupBy("list").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["list"]], sizes[r["list"]] = r["radius"], r["n"]
    return Lists(metric, centroids, radii, sizes)


def _probe(rows: DataFrame, ids: list[str], q: np.ndarray, probes: np.ndarray, k: int, metric: str, digits: int | None) -> DataFrame:
    """Best k rows of each query within the lists it probes. probes: queries x lists."""
    import pyarrow as pa

    wanted = np.flatnonzero(probes.any(0)).tolist()
    shared = rows.sparkSession.sparkContext.broadcast((ids, q, probes))

    def run(batches):
        ids, q, probes = shared.value
        best = RunningTopK(len(q), k)
        for batch in batches:
            lists = batch.column(2).to_numpy()
            order = np.argsort(lists, kind="stable")
            names = np.asarray(batch.column(0).to_pylist(), dtype=str)
            block = dense(batch.column(1), dim=q.shape[1])
            for at in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
                which = np.flatnonzero(probes[:, lists[at[0]]]) if len(at) else ()
                for first, end in slices(len(at), len(which)) if len(which) else ():
                    some = at[first:end]
                    dist = distances(block[some], q[which], metric)
                    best.add(dist if digits is None else np.round(dist, digits), dist, names[some], which)
        at, dist, found = best.result()
        yield pa.record_batch([pa.array([ids[i] for i in at.tolist()], pa.string()), pa.array(found.tolist(), pa.string()), pa.array(dist)],
                              ["query_id", "doc_id", "distance"])

    return rows.where(F.col("list").isin(wanted)).select("doc_id", "vector", "list").mapInArrow(run, HITS)


def _best(hits: DataFrame, k: int, digits: int | None) -> DataFrame:
    key = F.col("distance") if digits is None else F.round("distance", int(digits))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(key, "doc_id"))).where(F.col("rank") <= k)


def _euclidean(distance: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(np.maximum(distance, 0) if metric == "l2" else np.maximum(2 * distance, 0))


def search(rows: DataFrame, lists: Lists, queries: DataFrame, k: int = 10, probes: int = 8, *, exact: bool = False,
           rank_digits: int | None = None) -> DataFrame:
    """query_id, doc_id, distance, rank. rows: doc_id, vector, list; queries: query_id, qvec, in blocks of
    about ``QUERY_BLOCK``. With ``exact`` every further list that can hold a closer row is read too."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], HITS + ", rank int")
    if k <= 0:
        return empty
    queries = staged(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")),
                     "ivf-queries")
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), empty
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        if not block:
            continue
        ids, q = [r["query_id"] for r in block], np.asarray([r["qvec"] for r in block], np.float64)
        far = _apart(_scaled(q, lists.metric), lists.centroids)
        far = np.where(lists.sizes[None, :] > 0, far, np.inf)
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, np.argsort(far, axis=1, kind="stable")[:, :probes], True, 1)
        hits = _probe(rows, ids, q, first, k, lists.metric, rank_digits)
        if exact:
            hits = staged(_best(hits, k, rank_digits).drop("rank"), "ivf-hits")
            ends = {r["query_id"]: (r["n"], r["last"]) for r in hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last")).collect()}
            last = np.array([ends[i][1] if i in ends and ends[i][0] >= k else np.inf for i in ids])
            # a little slack for rounding, of the distances and of the ranks
            reach = _euclidean(last + 10.0 ** -(rank_digits or 12) + 1e-12, lists.metric) + 1e-9
            rest = ~first & (lists.sizes[None, :] > 0) & (far - lists.radii[None, :] <= reach[:, None])
            if rest.any():
                hits = hits.union(_probe(rows, ids, q, rest, k, lists.metric, rank_digits))
        out = out.union(_best(hits, k, rank_digits))
    return out


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true (query_id, doc_id) pairs that were found."""
    hit = true.join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    n, hits = hit.agg(F.count(F.lit(1)), F.count("hit")).first()
    return hits / n if n else 1.0


def calibrate(rows: DataFrame, lists: Lists, queries: DataFrame, k: int = 10, target: float = 0.95,
              rank_digits: int | None = None) -> tuple[int, float]:
    """The fewest probes (1, 2, 4, ...) whose recall on the given queries reaches the target, and that recall."""
    true = staged(search(rows, lists, queries, k, len(lists.centroids), rank_digits=rank_digits), "ivf-true")
    probes = 1
    while True:
        probes = min(probes, len(lists.centroids))
        reached = recall(search(rows, lists, queries, k, probes, rank_digits=rank_digits), true)
        if reached >= target or probes == len(lists.centroids):
            return probes, reached
        probes *= 2
