"""Thin queries over the operators, with DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, exact, flatgraph, html, huffman, near, packing, quality, sharding, surrogates, trie, urllists, whitening
from .staging import stage, table

#: key of the registered query; a real run brings its own
SURROGATE_KEY = "registered-query"


def op1_main_text(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_ids(spark, sf_dir):
    return huffman.round_trip(table(spark, sf_dir, "documents"))


def op4_surrogates(spark, sf_dir):
    return surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark, sf_dir):
    return exact.mark(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def _number(column):
    """0 to 65,535 by the MD5 of a string."""
    return F.conv(F.substring(F.md5(column), 1, 4), 16, 10).cast("int")


def dated_entries(pages):
    """List entries over the year of the captures, derived from the pages' own hosts, paths and URLs.

    Hosts are listed once or twice and may leave, domains are listed for 20 days, first path segments
    for 60 (half of them as exceptions), and one URL in ten from some day on.
    """
    start = F.lit("2024-01-01").cast("date")
    parts = pages.select(urllists.host(F.col("url")).alias("host"), F.regexp_extract("url", urllists.URL, 2).alias("path"),
                         F.regexp_extract("url", urllists.URL, 3).alias("query")).where("host != ''")

    def events(patterns, name, kind, verdict, *changes):
        n = patterns.distinct().withColumn("n", _number("pattern"))
        listed = F.array(*[F.when(when, F.struct(F.lit(action).alias("action"), F.date_add(start, F.col("n") % 300 + days).alias("day")))
                           for action, days, when in changes])
        return (n.select("pattern", "n", F.explode(listed).alias("e")).where("e is not null")
                .select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", verdict.alias("verdict"), "e.action", "e.day"))

    always, n = F.lit(True), F.col("n")
    block = F.lit("block")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    segment = F.regexp_extract("path", r"^/([^/]+)", 1)
    whole = F.concat("host", "path", "query")
    return (events(parts.select(F.col("host").alias("pattern")), "hosts", "host", block,
                   ("add", 0, always), ("remove", 30, n % 2 == 0), ("add", 90, n % 4 == 0))
            .unionByName(events(parts.select(domain.alias("pattern")).where("pattern != ''"), "domains", "domain", block,
                                ("add", 0, always), ("remove", 20, always)))
            .unionByName(events(parts.where(segment != "").select(F.concat_ws("/", "host", segment).alias("pattern")), "paths", "prefix",
                                F.when(n % 2 == 0, "allow").otherwise("block"), ("add", 0, always), ("remove", 60, always)))
            .unionByName(events(parts.select(whole.alias("pattern")), "urls", "url", block, ("add", 0, n % 10 == 0))))


def op8_url_lists(spark, sf_dir):
    """Every page, fetched on a day of 2024 by its id, judged as of that day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.expr("date_add(DATE'2024-01-01', CAST(page_id % 366 AS INT))"))
    return (urllists.judge(captures, dated_entries(pages))
            .select("capture.page_id", "capture.url", F.date_format("capture.day", "yyyy-MM-dd").alias("day"),
                    "verdict", "list", "kind", "pattern"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_near_vectors(spark, sf_dir):
    return flatgraph.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    """Every conversation begins with up to 8 turns of the first of its five, as many as its number gives."""
    turns = stage(trie.sequences(table(spark, sf_dir, "conversations")), "conversations")
    shared = F.crc32(F.col("conv_id").cast("string")) % 9
    return trie.trie(trie.with_shared_heads(turns, F.expr("conv_id - conv_id % 5"), shared, 8))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""

OP8_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?', 2) AS path,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?', 3) AS query
  FROM pages),
q AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, regexp_extract(path, '^/([^/]+)', 1) AS segment FROM p WHERE host <> ''),
pat AS (
  SELECT DISTINCT 'hosts' AS list, 'host' AS kind, host AS pattern FROM q
  UNION ALL SELECT DISTINCT 'domains', 'domain', domain FROM q WHERE domain <> ''
  UNION ALL SELECT DISTINCT 'paths', 'prefix', host || '/' || segment FROM q WHERE segment <> ''
  UNION ALL SELECT DISTINCT 'urls', 'url', host || path || query FROM q),
n AS (SELECT *, CAST('0x' || substr(md5(pattern), 1, 4) AS INT) AS n FROM pat),
e AS (
  SELECT *, 'add' AS action, 0 AS days FROM n WHERE list <> 'urls' OR n % 10 = 0
  UNION ALL SELECT *, 'remove', 30 FROM n WHERE list = 'hosts' AND n % 2 = 0
  UNION ALL SELECT *, 'add', 90 FROM n WHERE list = 'hosts' AND n % 4 = 0
  UNION ALL SELECT *, 'remove', 20 FROM n WHERE list = 'domains'
  UNION ALL SELECT *, 'remove', 60 FROM n WHERE list = 'paths'),
d AS (SELECT list, kind, pattern, action, DATE '2024-01-01' + CAST(n % 300 + days AS INT) AS since,
             CASE WHEN list = 'paths' AND n % 2 = 0 THEN 'allow' ELSE 'block' END AS verdict FROM e),
i AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS until FROM d),
k AS (
  SELECT r, day, 'host' AS kind, host AS pattern FROM q
  UNION ALL SELECT r, day, 'domain', domain FROM q
  UNION ALL SELECT r, day, 'prefix', host || '/' || segment FROM q WHERE segment <> ''
  UNION ALL SELECT r, day, 'url', host || path || query FROM q),
m AS (
  SELECT k.r, i.verdict, i.list, i.kind, i.pattern,
         row_number() OVER (PARTITION BY k.r ORDER BY CASE i.kind WHEN 'url' THEN 4 WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
                            length(i.pattern) DESC, i.verdict, i.list) AS best
  FROM k JOIN i ON k.kind = i.kind AND k.pattern = i.pattern AND i.action = 'add' AND k.day >= i.since AND (i.until IS NULL OR k.day < i.until))
SELECT p.page_id, p.url, strftime(p.day, '%Y-%m-%d') AS day, m.verdict, m.list, m.kind, m.pattern
FROM p LEFT JOIN m ON p.r = m.r AND m.best = 1"""

OP13_SQL = """
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                            lambda crc, x: xor(crc >> 8, list_reduce([xor(crc, x) & 255, 0, 0, 0, 0, 0, 0, 0, 0],
                                                                     lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1))))),
                4294967295::BIGINT) % 9 AS h FROM t),
r AS (
  SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
p AS (SELECT conv_id, n, depth, turns[1:depth] AS prefix FROM m),
v AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(prefix[depth]['text']) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY prefix, depth),
c AS (SELECT v.*, (SELECT count(*) FROM v w WHERE w.depth = v.depth + 1 AND w.prefix[1:v.depth] = v.prefix) AS n_children FROM v),
u AS (SELECT prefix, unnest(range(0, depth + 1)) AS top, (n_children = 0)::INT AS leaf, saved FROM c),
s AS (SELECT prefix[1:top] AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1)
SELECT c.conv_id, c.depth, o.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM c JOIN s ON s.prefix = c.prefix LEFT JOIN v o ON o.depth = c.depth - 1 AND o.prefix = c.prefix[1:c.depth - 1]"""

QUERIES = {f.__name__: f for f in (op1_main_text, op2_near_dedup, op3_token_ids, op4_surrogates, op5_decontaminate, op6_exact_dedup, op7_sharding,
                                op8_url_lists, op9_packing, op10_quality, op11_near_vectors, op12_whitening, op13_prefix_trie, pipeline)}
ORACLES = {"op6_exact_dedup": OP6_SQL, "op8_url_lists": OP8_SQL, "op13_prefix_trie": OP13_SQL}
