"""Vector index: document build, hash embedding, exact k-NN, re-ranking.

Scale notes
-----------
* Hash embedding is a projection of each row, in Arrow batches; it shuffles nothing.
* k-NN is exact: all indexed documents are scored against the stated query set, block by
  block. A block holds about ``QUERY_BLOCK`` queries (by hash) and is one broadcast; the
  same plan serves every number of queries, with one pass over the index per block. Each
  task keeps a running top-k over all its Arrow batches and yields it once, so at most
  k rows per query and task are shuffled.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from typing import Mapping, Sequence

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import staged
from .topk import RunningTopK, slices

#: queries in a block, on average
QUERY_BLOCK = 4096

# --- fixed values: document metadata keys ---
META_FIELDS = {"call_id": "call_id", "start_time": "start_time", "agent_id": "agent_id", "agent": "agent",
               "campaign": "campaign", "type": "Type", "outcome": "Outcome", "product": "product"}
# --- end fixed values ---


def prepare_docs(df: DataFrame, fields: Sequence[str] = ("transcript",)) -> DataFrame:
    """(doc_id, text, metadata): non-blank fields joined by newline; empty text dropped."""
    parts = [tx.trimmed(F.col(f).cast("string")) if f in df.columns else F.lit(None).cast("string")
             for f in fields]
    text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")
    meta = []
    for k, c in META_FIELDS.items():
        v = F.col(c) if c in df.columns else F.lit("")
        if c == "product" and "product" not in df.columns and "product_name" in df.columns:
            v = F.col("product_name")                       # D36
        if c == "start_time" and c in df.columns:
            v = F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")
        meta += [F.lit(k), F.coalesce(v.cast("string"), F.lit(""))]
    out = df.select(F.col("call_id").cast("string").alias("doc_id"), text.alias("text"),
                    F.create_map(*meta).alias("metadata"))
    return out.filter(F.col("text").rlike(tx.NOT_BLANK))


def validate_docs(docs: DataFrame, id_field: str = "doc_id", text_field: str = "text") -> DataFrame:
    """One-pass violation counts: missing columns, empty ids, empty texts."""
    missing = [c for c in (id_field, text_field) if c not in docs.columns]
    if missing:
        spark = docs.sparkSession
        return spark.createDataFrame([(len(missing), 0, 0)],
                                     "missing_columns int, empty_ids bigint, empty_texts bigint")
    return docs.agg(
        F.lit(0).alias("missing_columns"),
        F.count_if(F.coalesce(F.col(id_field).cast("string"), F.lit("")) == "").alias("empty_ids"),
        F.count_if(F.coalesce(tx.unicode_trim(F.col(text_field).cast("string")), F.lit("")) == "")
        .alias("empty_texts"))


def hash_embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               dim: int = vx.HASH_DIM) -> DataFrame:
    """V1: docs + sparse L2-normalized hash vector ``vec_idx array<int>``, ``vec_val array<double>``
    (sorted by index; empty arrays for a text without tokens).

    A projection of each row: rows with equal or null ids stay apart and nothing is shuffled. Texts are lower-cased by
    Spark and counted in Arrow batches inside the tasks; a task keeps the buckets of words it has met, a bounded number."""
    lowered = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumn("_e", _embedder(int(dim))(lowered)).select("*", "_e.vec_idx", "_e.vec_val").drop("_e")


#: words whose buckets a task keeps, and texts of one piece of the answer
KNOWN_WORDS, EMBED_ROWS = 1 << 17, 1024


def _embedder(dim: int):
    """A function of a column of lower-cased texts to their vectors as (vec_idx, vec_val)."""
    from typing import Iterator

    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("vec_idx", pa.list_(pa.int32())), ("vec_val", pa.list_(pa.float64()))])

    def vectors(texts: pa.Array, known: dict) -> pa.Array:
        ends, idx, val = [0], [np.zeros(0, np.int32)], [np.zeros(0)]
        for text in texts.to_pylist():
            words = text.split()                # at WS_CLASS, which is what Python calls white space
            at = []
            for w in words:
                bucket = known.get(w)
                if bucket is None:
                    bucket = int(md5(w.encode("utf-8")).hexdigest()[:8], 16) % dim
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = bucket
                at.append(bucket)
            counts = np.bincount(np.array(at, dtype=np.int64), minlength=dim)
            held = np.flatnonzero(counts)
            n = counts[held].astype(np.float64)
            idx.append(held.astype(np.int32))
            val.append(n / np.sqrt((n * n).sum()) if len(n) else n)
            ends.append(ends[-1] + len(held))
        ends = pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate(idx), pa.int32())),
                                           pa.ListArray.from_arrays(ends, pa.array(np.concatenate(val), pa.float64()))], ["vec_idx", "vec_val"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict = {}
        for texts in batches:
            parts = [vectors(texts.slice(k, EMBED_ROWS), known) for k in range(0, len(texts), EMBED_ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "struct<vec_idx:array<int>,vec_val:array<double>>")


def hash_sparse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                dim: int = vx.HASH_DIM) -> DataFrame:
    """V1 (sparse): (id, bucket, weight), a row for each bucket of each document row."""
    e = hash_embed(docs.select(id_col, text_col), id_col, text_col, dim)
    return e.select(F.col(id_col), F.inline(F.arrays_zip(F.col("vec_idx").alias("bucket"),
                                                         F.col("vec_val").alias("weight"))))


def to_dense(idx: str = "vec_idx", val: str = "vec_val", dim: int = vx.HASH_DIM):
    """Dense ``array<double>`` of a sparse vector (used for the small query side)."""
    m = F.map_from_arrays(F.col(idx), F.col(val))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(m[i], F.lit(0.0)))


def batched_embedder(embed, batch: int = 64, name: str = "vector"):
    """V7: an embedder for ``embed_texts`` from a function of a list of texts to a list of vectors, called in the
    tasks with at most ``batch`` texts at a time (null counts as empty). What it needs once a task (a model) it may
    load on its first call."""
    def embedder(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        from typing import Iterator

        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                given, out = texts.fillna("").tolist(), []
                for k in range(0, len(given), batch):
                    part = embed(given[k:k + batch])
                    if len(part) != len(given[k:k + batch]):
                        raise ValueError(f"the embedder gave {len(part)} vectors for {len(given[k:k + batch])} texts")
                    out += [[float(x) for x in v] for v in part]
                yield pd.Series(out, dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn(name, pandas_udf(run, "array<double>")(F.col(text_col)))

    return embedder


def embed_texts(texts: DataFrame, id_col: str, text_col: str, embedder=None,
                dim: int = vx.HASH_DIM) -> DataFrame:
    """V7: pluggable embedder. ``embedder`` is a function (DataFrame, id, text) -> DataFrame with
    a ``vector`` column (e.g. wrapping an iterator ``pandas_udf`` model); default is V1."""
    if embedder is None:
        return hash_embed(texts, id_col, text_col, dim)
    return embedder(texts, id_col, text_col)


def _doc_side(index: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(doc_id, vector parts, squared norm) — the norm is computed once per document."""
    if "vec_idx" in index.columns and vec_col not in index.columns:
        return index.select(F.col(id_col).alias("doc_id"), "vec_idx", "vec_val",
                            vx.sq_norm(F.col("vec_val")).alias("_dsq"))
    return index.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("_dv"),
                        vx.sq_norm(F.col(vec_col)).alias("_dsq"))


def _pair_distance(cols: list[str], metric: str):
    if metric.lower() == "l2":
        dense = F.col("_dv") if "_dv" in cols else F.transform(
            F.sequence(F.lit(0), F.size("qvec") - 1),
            lambda i: F.coalesce(F.try_element_at(F.map_from_arrays("vec_idx", "vec_val"), i.cast("int")), F.lit(0.0)))
        return vx.sq_l2(dense, F.col("qvec"))
    if "vec_idx" in cols:
        dotp = vx.sparse_dot(F.col("vec_idx"), F.col("vec_val"), F.col("qvec"))
    else:
        dotp = vx.dot(F.col("_dv"), F.col("qvec"))
    return vx.distance_from_parts(dotp, F.col("_dsq"), F.col("_qsq"), metric)


def dense(*columns, dim: int) -> np.ndarray:
    """Rows of a list column (or of bucket and weight lists) as a matrix of ``dim`` columns."""
    lengths = columns[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    if len(columns) == 1:
        return flat[0].astype(np.float64).reshape(len(lengths), dim)
    block = np.zeros((len(lengths), dim))
    block[np.repeat(np.arange(len(lengths)), lengths), flat[0].astype(np.int64)] = flat[1]
    return block


def distances(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row of a block to every query (V3)."""
    if metric == "l2":
        return np.stack([((block - v) ** 2).sum(axis=1) for v in queries], axis=1)
    dots = block @ queries.T
    if metric == "cosine":
        den = np.sqrt((block * block).sum(axis=1))[:, None] * np.sqrt((queries * queries).sum(axis=1))[None, :]
        dots = np.where(den == 0, 0.0, dots / np.where(den == 0, 1.0, den))
    return 1.0 - dots


def _score(docs: DataFrame, queries: DataFrame, k: int, metric: str,
           rank_digits: int | None) -> DataFrame:
    """Score every document against one block of queries; exact top-k per query.

    The dot products are BLAS work: each task turns its documents into dense blocks of bounded
    size, multiplies them with the broadcast query matrix and keeps a running top-k per query
    (ties -> doc_id) until its input ends. Only those partial winners are shuffled;
    ``row_number() <= k`` picks the global top-k from them. Squared L2 sums the squared
    differences: the expanded form loses small distances. A row without a vector is no neighbour."""
    spark = docs.sparkSession
    rows = queries.select("query_id", "qvec").collect()          # one block
    if not rows:
        return spark.createDataFrame([], "query_id string, doc_id string, distance double, rank int")
    qids = [str(r.query_id) for r in rows]
    qmat = np.asarray([list(r.qvec) for r in rows], dtype=np.float64)
    shared = spark.sparkContext.broadcast((qids, qmat))
    sparse = "vec_idx" in docs.columns
    metric = metric.lower()
    kk = int(k)

    def score(batches):
        import pyarrow as pa
        q_ids, q = shared.value
        best = RunningTopK(len(q), kk)
        for batch in batches:
            ids = np.asarray(batch.column(0).to_pylist(), dtype=str)
            for first, end in slices(batch.num_rows, len(q), q.shape[1]):
                block = dense(*(batch.column(c).slice(first, end - first) for c in range(1, batch.num_columns)), dim=q.shape[1])
                dist = distances(block, q, metric)
                best.add(dist if rank_digits is None else np.round(dist, rank_digits), dist, ids[first:end])
        at, dist, ids = best.result()
        yield pa.record_batch([pa.array([q_ids[k] for k in at.tolist()], pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(dist)],
                              ["query_id", "doc_id", "distance"])

    cols = ["vec_idx", "vec_val"] if sparse else ["_dv"]
    rows = docs.where(F.col(cols[0]).isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), *[
        F.col(c).cast("array<int>" if c == "vec_idx" else "array<double>").alias(c) for c in cols])
    partial = rows.mapInArrow(score, "query_id string, doc_id string, distance double")
    key = F.col("distance") if rank_digits is None else F.round(F.col("distance"), int(rank_digits))
    w = Window.partitionBy("query_id").orderBy(key, F.col("doc_id"))
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kk)


def knn(index: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", *,
        vec_col: str = "vector", id_col: str = "doc_id",
        where: Mapping[str, str] | None = None, rank_digits: int | None = None) -> DataFrame:
    """Exact k nearest documents per query.

    ``index`` holds a dense ``vector`` or a sparse ``vec_idx``/``vec_val`` pair; ``queries``
    has ``query_id`` and a dense ``qvec``. ``where`` filters on ``metadata[key] == value``
    before scoring. ``k <= 0`` gives an empty result. Returns (query_id, doc_id, distance, rank).
    ``rank_digits`` orders by the distance rounded to that many digits (ties -> doc_id), which
    makes ranks independent of last-bit floating-point noise.
    """
    if where:
        for key, val in where.items():
            index = index.filter(F.col("metadata")[key] == F.lit(val))
    if k <= 0:
        return index.sparkSession.createDataFrame(
            [], "query_id string, doc_id string, distance double, rank int")
    # queries are collected block by block, and the index read once a block: neither is computed anew
    queries = staged(queries.select("query_id", "qvec"), "knn-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    docs = _doc_side(index if blocks == 1 else staged(index, "knn-index"), vec_col, id_col)
    hashed = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_score(docs, queries.filter(hashed == b), k, metric, rank_digits) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def question_vectors(questions: DataFrame, id_col: str = "question_id", text_col: str = "text",
                     dim: int = vx.HASH_DIM) -> DataFrame:
    """Embed question texts as k-NN queries (query_id, qvec); empty texts give no query."""
    q = questions.filter(F.coalesce(tx.unicode_trim(F.col(text_col)), F.lit("")) != "")
    emb = hash_embed(q.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")),
                     "query_id", "text", dim)
    return emb.select("query_id", to_dense("vec_idx", "vec_val", dim).alias("qvec"))


def rank_intersect(scope: DataFrame, ranked: DataFrame, id_col: str = "call_id") -> DataFrame:
    """Keep scope rows whose id is ranked, ordered by rank; with no ranked ids or no
    overlap the scope is returned unchanged (rank null). ``ranked`` is (doc_id, rank), bounded by k.

    The joined rows are written once: the overlap, the sort's sample and the sort all read them."""
    r = ranked.select(F.col("doc_id").alias("_rid"), F.col("rank"))
    joined = staged(scope.join(F.broadcast(r), scope[id_col] == r["_rid"], "left").drop("_rid"), "rank-intersect")
    overlap = joined.select(F.count_if(F.col("rank").isNotNull())).scalar()
    return (joined.filter((overlap == 0) | F.col("rank").isNotNull())
                  .orderBy(F.col("rank").asc_nulls_last(), F.col(id_col)))


def _with_queries(rows: DataFrame, query_vecs: DataFrame, metric: str, has_vector=None) -> DataFrame:
    """Every row with its distance to each query of the stated set: (columns, query_id, distance).

    The queries are one array, computed once as a scalar subquery, and each row is expanded by
    it; the row set per query never changes."""
    one = query_vecs.select("query_id", vx.as_double("qvec").alias("qvec"), vx.sq_norm(F.col("qvec")).alias("_qsq"))
    queries = one.agg(F.collect_list(F.struct("query_id", "qvec", "_qsq")).alias("q")).select("q").scalar()
    out = rows.withColumn("_qs", queries).select("*", F.inline("_qs")).drop("_qs")
    dist = _pair_distance(out.columns, metric)
    return out.withColumn("distance", dist if has_vector is None else F.when(has_vector, dist))


def rerank_scope(scope: DataFrame, index: DataFrame, query_vecs: DataFrame, metric: str = "cosine",
                 id_col: str = "call_id", vec_col: str = "vector") -> DataFrame:
    """J2 (D31): the scope rows with their distance to each query vector (``query_id``); per query the
    row set is the scope. Rows without an index vector get a null distance (ordered last)."""
    docs = _doc_side(index, vec_col, "doc_id").withColumnRenamed("doc_id", "_did")
    s = scope.join(docs, scope[id_col] == docs["_did"], "left")
    out = _with_queries(s, query_vecs, metric, F.col("_did").isNotNull())
    return out.drop(*docs.columns, "qvec", "_qsq")


def rerank_indexed(index: DataFrame, query_vecs: DataFrame, scope=None, metric: str = "cosine",
                   vec_col: str = "vector") -> DataFrame:
    """J2 for a scope that lives inside the index: the index rows passing ``scope`` (a Column
    predicate, e.g. on ``metadata``) with their distance to each query vector. No join: one
    pass over the index, so the documents' upstream work is done once."""
    rows = index if scope is None else index.filter(scope)
    return _with_queries(_doc_side(rows, vec_col, "doc_id"), query_vecs, metric).select("query_id", "doc_id", "distance")


def topk_display(ranked_scope: DataFrame, k: int, id_col: str = "call_id", semantic: bool = True) -> DataFrame:
    """O3: first ``max(1,k)`` rows by (distance, id) plus the full scope count; with ``semantic`` off
    all rows in id order, with a null distance."""
    rows = ranked_scope if semantic else ranked_scope.withColumn("distance", F.lit(None).cast("double"))
    order = [F.col("distance").asc_nulls_last(), F.col(id_col)]
    scope_count = ranked_scope.select(F.count(F.lit(1))).scalar()
    top = rows.orderBy(*order)
    return (top.limit(max(1, int(k))) if semantic else top).withColumn("scope_count", scope_count)


def present(scope: DataFrame, question: str, *, semantic: bool, top_k: int | None, reorder=None, id_col: str = "call_id") -> DataFrame:
    """O3: the rows to show, with ``position`` and the ``scope_count`` of the whole scope.

    ``reorder`` is a function of (scope, question) that gives the scope's rows with a ``rank`` column, and none more or
    fewer. One that fails, or that changes the number of rows, is not used: rows are then in id order, as without
    semantic ranking. Only with semantic ranking are at most ``max(1, top_k)`` rows shown."""
    rows = staged(scope, "present-scope")
    ranked = None
    if semantic and reorder is not None:
        try:
            found = staged(reorder(rows, question).select(*rows.columns, "rank"), "present-ranked")
            ranked = found if found.count() == rows.count() else None
        except Exception:  # whatever a hook raises, the scope is shown as it is
            ranked = None
    if ranked is None:
        ranked = rows.withColumn("rank", F.lit(0))
    count = rows.select(F.count(F.lit(1))).scalar()
    order = (F.col("rank").asc_nulls_last(), F.col(id_col))
    if semantic and top_k is not None:
        # a limited window keeps top_k rows a task
        out = ranked.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") <= max(1, int(top_k)))
    else:
        out = numbered_in_order(ranked, order, "position")
    return out.withColumn("scope_count", count).drop("rank")


def numbered_in_order(rows: DataFrame, order: Sequence, name: str) -> DataFrame:
    """All rows with their number from 1 in ``order``. They are sorted in ranges by many tasks and written; a range's
    first number is the sum of the sizes of those before it, of which there are as many as ranges."""
    placed = staged(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    placed = placed.select("*", F.shiftright("_place", 33).alias("_range"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(name, number.cast("int")).drop("_place", "_range", "_of", "_before")
