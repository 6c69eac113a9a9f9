"""Registered queries: index documents, hash embedding, exact k-NN, re-ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import ivf
from ..operators import merge as mg
from ..operators import vectors as vec
from ..session import scratch_path, staged
from ..sources import collections
from . import fixtures as fx
from .common import LABELED_SQL, labeled, r6
from .oracle_sql import q, r6 as sr6
from .registry import register

WS = tx.WS_CLASS
DOC_FIELDS = ("transcript", "product_name")
QUESTION_TEXT = "the customer asked about la and der plan for the order"


def _trim_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


DOCS_SQL = LABELED_SQL.rstrip() + f""",
docs AS (
  SELECT call_id AS doc_id,
         array_to_string(list_filter([{_trim_sql('transcript')}, {_trim_sql('product_name')}],
                                     lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS text,
         coalesce(campaign, '') AS m_campaign, coalesce(Type, '') AS m_type,
         coalesce(Outcome, '') AS m_outcome
  FROM labeled),
docs_ne AS (SELECT * FROM docs WHERE {_trim_sql('text')} <> '')
"""


def _sparse_sql(src: str, id_col: str, text_col: str, name: str) -> str:
    return f""",
{name}_t AS (SELECT {id_col} AS id, unnest(string_split_regex(lower(coalesce({text_col}, '')), '{WS}+')) AS tok
             FROM {src}),
{name}_c AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket,
                    CAST(count(*) AS DOUBLE) AS n
             FROM {name}_t WHERE tok <> '' GROUP BY 1, 2),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}_c)
"""


def index(spark, sf, calls=None):
    docs = vec.prepare_docs(labeled(spark, sf) if calls is None else calls, DOC_FIELDS)
    return vec.hash_embed(docs, "doc_id", "text")


def _labeled_once(spark, sf):
    """The labeled calls, for queries that read them as scope and as index."""
    return staged(labeled(spark, sf), "labeled")


@register("index_docs", covers="P13 D36", oracle=DOCS_SQL + """
SELECT doc_id, sha256(text) AS text_sha, m_campaign AS campaign, m_type AS type, m_outcome AS outcome
FROM docs_ne""")
def index_docs(spark, sf):
    d = vec.prepare_docs(labeled(spark, sf), DOC_FIELDS)
    return d.select("doc_id", F.sha2("text", 256).alias("text_sha"),
                    F.col("metadata")["campaign"].alias("campaign"), F.col("metadata")["type"].alias("type"),
                    F.col("metadata")["outcome"].alias("outcome"))


@register("doc_validation", covers="P14", oracle=DOCS_SQL + f"""
SELECT 0 AS missing_columns, count(*) FILTER (WHERE coalesce(doc_id, '') = '') AS empty_ids,
       count(*) FILTER (WHERE coalesce({_trim_sql('text')}, '') = '') AS empty_texts FROM docs""")
def doc_validation(spark, sf):
    # validate the unfiltered build (before empty texts are dropped)
    raw = labeled(spark, sf).select(F.col("call_id").alias("doc_id"), F.array_join(F.filter(
        F.array(*[tx.unicode_trim(F.col(c)) for c in DOC_FIELDS]), lambda x: x.isNotNull() & (x != "")),
        "\n").alias("text"))
    return vec.validate_docs(raw)


@register("hash_embedding", covers="V1", oracle=DOCS_SQL.rstrip() + _sparse_sql("docs_ne", "doc_id", "text", "sp") + f"""
SELECT id AS doc_id, bucket, {sr6('weight')} AS weight FROM sp""")
def hash_embedding(spark, sf):
    docs = vec.prepare_docs(labeled(spark, sf), DOC_FIELDS)
    return vec.hash_sparse(docs, "doc_id", "text").select("doc_id", "bucket", r6("weight").alias("weight"))


@register("vector_norms", covers="T14", oracle="""
SELECT vec_id, round(sqrt(list_reduce(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x),
                                       lambda a, b: a + b)), 6) AS norm
FROM embeddings""")
def vector_norms(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", r6(vx.l2_norm(vx.as_double("embedding"))).alias("norm"))


def centroid_queries(spark, sf):
    """One query per label: the label's mean embedding rounded to 4 digits."""
    e = fx.table(spark, sf, "embeddings")
    pe = e.select("label", F.posexplode(vx.as_double("embedding")).alias("pos", "x"))
    per = pe.groupBy("label", "pos").agg(F.round(F.avg("x"), 4).alias("x"))
    # one entry per dimension (bounded by the vector length)
    q = per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return q.select(F.col("label").cast("string").alias("query_id"),
                    F.transform("s", lambda s: s["x"]).alias("qvec"))


def _emb_index(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("doc_id"), vx.as_double("embedding").alias("vector"))


CENTROIDS_SQL = """WITH ex AS (
  SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x
  FROM embeddings),
cq AS (SELECT CAST(label AS VARCHAR) AS query_id, list(round(avg_x, 4) ORDER BY pos) AS qvec
       FROM (SELECT label, pos, avg(x) AS avg_x FROM ex GROUP BY label, pos) GROUP BY label),
ev AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
"""


def _dist_sql(metric: str) -> str:
    dotp = "list_reduce(list_transform(list_zip(v, qvec), lambda p: p[1] * p[2]), lambda a, b: a + b)"
    nv = "sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b))"
    nq = "sqrt(list_reduce(list_transform(qvec, lambda x: x * x), lambda a, b: a + b))"
    if metric == "cosine":
        return f"1.0 - CASE WHEN {nv} * {nq} = 0 THEN 0.0 ELSE {dotp} / ({nv} * {nq}) END"
    if metric == "l2":
        return "list_reduce(list_transform(list_zip(v, qvec), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)"
    return f"1.0 - {dotp}"


def _knn_sql(metric: str, k: int) -> str:
    return CENTROIDS_SQL + f"""
SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM (
  SELECT query_id, doc_id, distance,
         row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank
  FROM (SELECT cq.query_id, ev.doc_id, {_dist_sql(metric)} AS distance FROM ev, cq))
WHERE rank <= {k}"""


def _make_knn(metric):
    def build(spark, sf):
        out = vec.knn(_emb_index(spark, sf), centroid_queries(spark, sf), k=5, metric=metric, rank_digits=9)
        return out.withColumn("distance", r6("distance"))
    build.__name__ = f"knn_{metric}"
    register(f"knn_{metric}", covers="V3 V4 O9", oracle=_knn_sql(metric, 5))(build)


for _m in ("cosine", "l2", "ip"):
    _make_knn(_m)


def _bench_queries(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    return vec.question_vectors(b.select(F.col("item_id").cast("string").alias("question_id"), "text"))


def _sparse_knn_sql(where: str, k: int) -> str:
    """Cosine distance on L2-normalized hash vectors = 1 - sparse dot product."""
    return (DOCS_SQL.rstrip() + _sparse_sql("docs_ne", "doc_id", "text", "sd")
            + _sparse_sql("(SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark WHERE "
                          f"{_trim_sql('coalesce(text, ' + q('') + ')')} <> '')", "qid", "text", "sq")
            + f""",
cand AS (SELECT doc_id FROM docs_ne WHERE {where}),
dots AS (SELECT sq.id AS query_id, sd.id AS doc_id, sum(sq.weight * sd.weight) AS d
         FROM sq JOIN sd ON sq.bucket = sd.bucket WHERE sd.id IN (SELECT doc_id FROM cand) GROUP BY 1, 2),
allp AS (SELECT qs.query_id, cand.doc_id, 1.0 - coalesce(dots.d, 0.0) AS distance
         FROM (SELECT DISTINCT id AS query_id FROM sq) qs CROSS JOIN cand
         LEFT JOIN dots ON dots.query_id = qs.query_id AND dots.doc_id = cand.doc_id)
SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank FROM allp)
WHERE rank <= {k}""")


@register("knn_where", covers="F9 V4 V1", oracle=_sparse_knn_sql("m_campaign = 'BUILDING'", 3))
def knn_where(spark, sf):
    idx = index(spark, sf)
    out = vec.knn(idx, _bench_queries(spark, sf), k=3, metric="cosine", where={"campaign": "BUILDING"},
                  rank_digits=9)
    return out.withColumn("distance", r6("distance"))


@register("knn_text", covers="V4 V5 O9", oracle=_sparse_knn_sql("TRUE", 3))
def knn_text(spark, sf):
    out = vec.knn(index(spark, sf), _bench_queries(spark, sf), k=3, metric="cosine", rank_digits=9)
    return out.withColumn("distance", r6("distance"))


# ------------------------------------------------------------------ inverted lists
IVF_K = 10
IVF_SQL = f"""WITH ev AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cq AS (SELECT doc_id AS query_id, v AS qvec FROM ev WHERE CAST(doc_id AS BIGINT) % 50 = 0)
SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM (
  SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank
  FROM (SELECT cq.query_id, ev.doc_id, {{metric}} AS distance FROM ev, cq))
WHERE rank <= {IVF_K}"""


def _stored_lists(spark, sf, metric="cosine"):
    """The embeddings in inverted lists, and the queries: every vector whose id is divisible by 50."""
    root, idx = scratch_path(spark, f"lists-{uuid.uuid4().hex[:12]}"), _emb_index(spark, sf)
    collections.save_lists(idx, root, "embeddings", metric)
    queries = idx.filter(F.col("doc_id").cast("bigint") % 50 == 0).select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qvec"))
    return (*collections.open_lists(spark, root, "embeddings"), queries)


def _make_ivf(metric):
    def build(spark, sf):
        rows, lists, queries = _stored_lists(spark, sf, metric)
        out = ivf.search(rows, lists, queries, IVF_K, probes=4, exact=True, rank_digits=9)
        return out.withColumn("distance", r6("distance"))
    build.__name__ = f"knn_lists_{metric}"
    register(f"knn_lists_{metric}", covers="V4", oracle=IVF_SQL.replace("{metric}", _dist_sql(metric)))(build)


for _m in ("cosine", "l2"):
    _make_ivf(_m)


@register("knn_lists_recall", covers="V4", oracle=f"""
SELECT count(*) AS queries, {IVF_K} AS k, TRUE AS reached, TRUE AS several_lists FROM embeddings WHERE vec_id % 50 = 0""")
def knn_lists_recall(spark, sf):
    """Recall of the approximate search, against all rows, with the probes that calibration chose."""
    rows, lists, queries = _stored_lists(spark, sf)
    probes, reached = ivf.calibrate(rows, lists, queries, IVF_K, 0.9, rank_digits=9)
    found = ivf.search(rows, lists, queries, IVF_K, probes, rank_digits=9)
    return found.agg(F.countDistinct("query_id").alias("queries"), F.lit(IVF_K).alias("k"), F.lit(reached >= 0.9).alias("reached"),
                     F.lit(len(lists.centroids) > 1).alias("several_lists"))


# ------------------------------------------------------------------ upsert / delete
UPSERT_SQL = DOCS_SQL.rstrip() + """,
prio AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS priority FROM orders),
existing AS (SELECT d.doc_id, d.text FROM docs_ne d JOIN prio p ON p.doc_id = d.doc_id WHERE p.priority <> '5-LOW'),
incoming AS (SELECT d.doc_id, d.text || ' v2' AS text FROM docs_ne d JOIN prio p ON p.doc_id = d.doc_id
             WHERE p.priority IN ('1-URGENT', '2-HIGH', '5-LOW'))
"""


def _upsert_frames(spark, sf):
    docs = vec.prepare_docs(labeled(spark, sf), DOC_FIELDS).select("doc_id", "text")
    docs = docs.join(fx.order_priority(spark, sf).withColumnRenamed("order_id", "doc_id"), "doc_id")
    existing = docs.filter(~F.col("priority").isin(*fx.BATCH1_EXCLUDES)).select("doc_id", "text")
    incoming = (docs.filter(F.col("priority").isin(*fx.BATCH2_PRIORITIES))
                    .select("doc_id", F.concat(F.col("text"), F.lit(" v2")).alias("text")))
    return existing, incoming


@register("upsert_docs", covers="J6", oracle=UPSERT_SQL + """
SELECT doc_id, sha256(text) AS text_sha FROM existing WHERE doc_id NOT IN (SELECT doc_id FROM incoming)
UNION ALL SELECT doc_id, sha256(text) FROM incoming""")
def upsert_docs(spark, sf):
    existing, incoming = _upsert_frames(spark, sf)
    return mg.upsert(existing, incoming, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha"))


@register("delete_docs", covers="J7 U6", oracle=DOCS_SQL + """
SELECT doc_id FROM docs_ne WHERE doc_id NOT IN (SELECT doc_id FROM docs_ne WHERE m_outcome = 'Refund')""")
def delete_docs(spark, sf):
    docs = vec.prepare_docs(labeled(spark, sf), DOC_FIELDS)
    ids = docs.filter(F.col("metadata")["outcome"] == "Refund").select("doc_id")
    return mg.delete_ids(docs, ids, "doc_id").select("doc_id")


# ------------------------------------------------------------------ re-ranking
def _question_vec(spark):
    qdf = spark.createDataFrame([("q", QUESTION_TEXT)], "question_id string, text string")
    return vec.question_vectors(qdf)


def _scope(calls):
    return calls.filter(F.col("Type") == "Support")


QVEC_SQL = _sparse_sql(f"(SELECT 'q' AS qid, {q(QUESTION_TEXT)} AS text)", "qid", "text", "qv")


def _scope_dist_sql() -> str:
    return (DOCS_SQL.rstrip() + _sparse_sql("docs_ne", "doc_id", "text", "sd") + QVEC_SQL + """,
scope AS (SELECT call_id FROM labeled WHERE Type = 'Support'),
dots AS (SELECT sd.id AS doc_id, sum(qv.weight * sd.weight) AS d FROM qv JOIN sd ON qv.bucket = sd.bucket
         GROUP BY 1),
sdist AS (SELECT s.call_id, CASE WHEN s.call_id IN (SELECT doc_id FROM docs_ne)
                                 THEN 1.0 - coalesce(dots.d, 0.0) END AS distance
          FROM scope s LEFT JOIN dots ON dots.doc_id = s.call_id)
""")


@register("rerank_scope", covers="J2 D31", oracle=_scope_dist_sql() + """
SELECT call_id, round(distance, 6) AS distance FROM sdist""")
def rerank_scope(spark, sf):
    # every gated call has text, so the Support scope is a subset of the index
    out = vec.rerank_indexed(index(spark, sf), _question_vec(spark), F.col("metadata")["type"] == "Support")
    return out.select(F.col("doc_id").alias("call_id"), r6("distance").alias("distance"))


RERANK_QUESTIONS = {"q1": QUESTION_TEXT, "q2": "refund of a broken order", "q3": "der die das und la que"}
MANY_SQL = (DOCS_SQL.rstrip() + _sparse_sql("docs_ne", "doc_id", "text", "sd")
            + _sparse_sql("(SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(t)})" for k, t in RERANK_QUESTIONS.items())
                          + ") AS v(qid, text))", "qid", "text", "qv"))


@register("rerank_many", covers="J2 D31", oracle=MANY_SQL + """,
scope AS (SELECT call_id FROM labeled WHERE Type = 'Support'),
held AS (SELECT * FROM docs_ne WHERE right(doc_id, 1) <> '3'),
dots AS (SELECT qv.id AS query_id, sd.id AS doc_id, sum(qv.weight * sd.weight) AS d FROM qv JOIN sd ON qv.bucket = sd.bucket
         GROUP BY 1, 2)
SELECT s.call_id, u.query_id, round(CASE WHEN h.doc_id IS NOT NULL THEN 1.0 - coalesce(dots.d, 0.0) END, 6) AS distance
FROM scope s CROSS JOIN (SELECT DISTINCT id AS query_id FROM qv) u LEFT JOIN held h ON h.doc_id = s.call_id
LEFT JOIN dots ON dots.doc_id = s.call_id AND dots.query_id = u.query_id""")
def rerank_many(spark, sf):
    """Several questions over one scope; calls ending in 3 are not in the index and keep a null distance."""
    qdf = spark.createDataFrame(list(RERANK_QUESTIONS.items()), "question_id string, text string")
    calls = _labeled_once(spark, sf)
    held = index(spark, sf, calls).filter(F.substring("doc_id", -1, 1) != "3")
    out = vec.rerank_scope(_scope(calls).select("call_id"), held, vec.question_vectors(qdf))
    return out.select("call_id", "query_id", r6("distance").alias("distance"))


@register("hash_embedding_dups", covers="V1", oracle=DOCS_SQL.rstrip() + f""",
dups AS (SELECT row_number() OVER () AS r, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN NULL ELSE right(doc_id, 1) END AS id,
                text FROM docs_ne),
t AS (SELECT r, unnest(string_split_regex(lower(text), '{WS}+')) AS tok FROM dups),
c AS (SELECT r, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket, count(*) AS n
      FROM t WHERE tok <> '' GROUP BY 1, 2)
SELECT d.id, sha256(d.text) AS text_sha, count(c.bucket) AS buckets, coalesce(sum(c.bucket), 0) AS bucket_sum,
       round(max(c.n) / sqrt(sum(c.n * c.n)), 6) AS top_weight
FROM dups d LEFT JOIN c ON c.r = d.r GROUP BY d.r, d.id, d.text""")
def hash_embedding_dups(spark, sf):
    """Documents whose ids repeat or are null are embedded one by one."""
    docs = vec.prepare_docs(labeled(spark, sf), DOC_FIELDS)
    n = F.col("doc_id").cast("bigint")
    docs = docs.select(F.when(n % 3 != 0, F.substring("doc_id", -1, 1)).alias("id"), "text")
    e = vec.hash_embed(docs, "id", "text")
    total = F.aggregate("vec_idx", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return e.select("id", F.sha2("text", 256).alias("text_sha"), F.size("vec_idx").cast("bigint").alias("buckets"),
                    total.alias("bucket_sum"), r6(F.array_max("vec_val")).alias("top_weight"))


@register("topk_display", covers="O3", oracle=_scope_dist_sql() + """
SELECT call_id, round(distance, 6) AS distance, (SELECT count(*) FROM sdist) AS scope_count
FROM sdist ORDER BY round(distance, 9) NULLS LAST, call_id LIMIT 10""")
def topk_display(spark, sf):
    ranked = vec.rerank_indexed(index(spark, sf), _question_vec(spark), F.col("metadata")["type"] == "Support")
    ranked = ranked.select(F.col("doc_id").alias("call_id"), F.round("distance", 9).alias("distance"))
    out = vec.topk_display(ranked, 10)
    return out.select("call_id", r6("distance").alias("distance"), "scope_count")


@register("rank_intersect", covers="J1 U5 W2", oracle=DOCS_SQL.rstrip() + _sparse_sql("docs_ne", "doc_id", "text", "sd")
          + QVEC_SQL + """,
dots AS (SELECT sd.id AS doc_id, sum(qv.weight * sd.weight) AS d FROM qv JOIN sd ON qv.bucket = sd.bucket
         GROUP BY 1),
alld AS (SELECT d.doc_id, 1.0 - coalesce(dots.d, 0.0) AS distance FROM docs_ne d
         LEFT JOIN dots ON dots.doc_id = d.doc_id),
ranked AS (SELECT doc_id, rank FROM (
             SELECT doc_id, row_number() OVER (ORDER BY round(distance, 9), doc_id) AS rank FROM alld)
           WHERE rank <= 50),
scope AS (SELECT call_id FROM labeled WHERE Type = 'Support'),
j AS (SELECT s.call_id, r.rank FROM scope s LEFT JOIN ranked r ON r.doc_id = s.call_id)
SELECT call_id, rank FROM j
WHERE (SELECT count(rank) FROM j) = 0 OR rank IS NOT NULL""")
def rank_intersect(spark, sf):
    calls = _labeled_once(spark, sf)
    ranked = vec.knn(index(spark, sf, calls), _question_vec(spark), k=50, metric="cosine", rank_digits=9)
    return vec.rank_intersect(_scope(calls).select("call_id"), ranked.select("doc_id", "rank")).select("call_id", "rank")


PRESENT_MODES = ("near", "losing", "failing", "off")


@register("present_reordered", covers="O3 J2", oracle=_scope_dist_sql() + """,
n AS (SELECT count(*) AS scope_count FROM sdist),
near AS (SELECT call_id, row_number() OVER (ORDER BY round(distance, 9) NULLS LAST, call_id) AS position FROM sdist),
plain AS (SELECT call_id, row_number() OVER (ORDER BY call_id) AS position FROM sdist)
SELECT 'near' AS mode, call_id, position, scope_count FROM near, n WHERE position <= 10
UNION ALL SELECT m.mode, call_id, position, scope_count FROM plain, n, (VALUES ('losing'), ('failing')) AS m(mode) WHERE position <= 10
UNION ALL SELECT 'off', call_id, position, scope_count FROM plain, n""")
def present_reordered(spark, sf):
    """A scope shown by a question's distance, by hooks that lose rows or fail (not used), and without semantic ranking."""
    calls = _labeled_once(spark, sf)
    ranked = vec.rerank_indexed(index(spark, sf, calls), _question_vec(spark), F.col("metadata")["type"] == "Support")
    # two hooks read the distances, four views the scope
    distances = staged(ranked.select(F.col("doc_id").alias("_did"), F.round("distance", 9).alias("rank")), "distances")
    scope_rows = staged(_scope(calls).select("call_id"), "scope")

    def near(scope, question):
        return scope.join(distances, scope["call_id"] == distances["_did"], "left")

    def losing(scope, question):
        return near(scope, question).where("rank < 1")

    def failing(scope, question):
        raise RuntimeError("no model")

    out = None
    for mode, hook in zip(PRESENT_MODES, (near, losing, failing, near)):
        shown = vec.present(scope_rows, QUESTION_TEXT, semantic=mode != "off", top_k=10, reorder=hook)
        shown = shown.select(F.lit(mode).alias("mode"), "call_id", "position", "scope_count")
        out = shown if out is None else out.unionByName(shown)
    return out


VOWELS = "aeiou"


@register("embedder_hook", covers="V7 V3 V4", oracle="""
WITH v AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, [""" + ", ".join(
    f"CAST(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{c}', '')) AS DOUBLE)" for c in VOWELS) + f"""] AS v FROM benchmark),
d AS (SELECT a.doc_id AS query_id, b.doc_id, {_dist_sql('cosine').replace('qvec', 'a.v').replace('list_zip(v,', 'list_zip(b.v,').replace('list_transform(v,', 'list_transform(b.v,')} AS distance
      FROM v a, v b)
SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank FROM d) WHERE rank <= 3""")
def embedder_hook(spark, sf):
    """Benchmark items embedded by a caller's function of lists of texts, and the three nearest of each."""
    def count_vowels(texts):
        return [[t.lower().count(c) for c in VOWELS] for t in texts]

    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text")
    embedded = vec.embed_texts(items, "doc_id", "text", vec.batched_embedder(count_vowels))
    queries = embedded.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qvec"))
    return vec.knn(embedded, queries, 3, rank_digits=9).withColumn("distance", r6("distance"))
