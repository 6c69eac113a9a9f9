"""Registered queries: sink round trips, file sources, payload scans, audit log, index store, stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters as flt
from ..operators import segments as sg
from ..operators import vectors as vec
from ..session import scratch_path, staged
from ..sources import io
from ..streaming import ingest
from . import fixtures as fx
from .common import LABELED_SQL, fmt_ts, labeled, r6
from .oracle_sql import CALLS_RAW_CTE, fmt_ts as sfmt, r6 as sr6, tokens as stokens
from .q_segments import ASSEMBLED_SQL, DURATIONS_SQL
from .q_storage import BATCHES_SQL
from .q_questions import _answer_sql
from .q_vectors import DOC_FIELDS, DOCS_SQL, _sparse_sql
from .registry import register


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("csv_roundtrip", covers="S1 S6 P2", oracle="WITH " + CALLS_RAW_CTE + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, {sr6('duration_seconds')} AS duration_seconds,
       agent_id, {sr6('amount')} AS amount, sha256(transcript) AS transcript_sha FROM calls_raw""")
def csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv")
    io.write_csv(fx.calls(spark, sf), path)
    back = io.read_calls_csv(spark, path, multiline=True)
    return back.select("call_id", fmt_ts("start_time").alias("start_time"),
                       r6("duration_seconds").alias("duration_seconds"), "agent_id",
                       r6("amount").alias("amount"), F.sha2("transcript", 256).alias("transcript_sha"))


@register("snapshot_roundtrip", covers="S4 S5 P5", oracle=LABELED_SQL + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, Connected, Type, Outcome FROM labeled""")
def snapshot_roundtrip(spark, sf):
    root = _scratch(spark, "snap")
    empty = io.load_snapshot(spark, root)                       # no version yet -> empty frame
    io.save_calls_snapshot(labeled(spark, sf).unionByName(empty.select(*labeled(spark, sf).columns)), root)
    back = io.load_snapshot(spark, root)
    return back.select("call_id", fmt_ts("start_time").alias("start_time"), "Connected", "Type", "Outcome")


@register("snapshot_csv_fallback", covers="S4", oracle="WITH " + CALLS_RAW_CTE + f"""
SELECT call_id, {sfmt('start_time')} AS start_time, agent_id, {sr6('amount')} AS amount, sha256(transcript) AS transcript_sha FROM calls_raw""")
def snapshot_csv_fallback(spark, sf):
    """No version is published, so the CSV export of the same calls is loaded."""
    path = _scratch(spark, "fallback")
    io.write_csv(fx.calls(spark, sf), f"{path}/calls.csv")
    back = io.load_snapshot(spark, f"{path}/snapshots", csv_fallback=f"{path}/calls.csv")
    return back.select("call_id", fmt_ts("start_time").alias("start_time"), "agent_id", r6("amount").alias("amount"),
                       F.sha2("transcript", 256).alias("transcript_sha"))


CSV_PARTS = 4


@register("csv_glob_rejects", covers="S2 S3 U1", oracle="WITH " + CALLS_RAW_CTE + f"""
SELECT call_id, agent_id, CASE WHEN CAST(call_id AS BIGINT) % {CSV_PARTS} <> 2 THEN campaign END AS campaign,
       CASE WHEN CAST(call_id AS BIGINT) % {CSV_PARTS} <> 2 THEN {sr6('amount')} END AS amount, 'included' AS reason
FROM calls_raw
UNION ALL SELECT NULL, NULL, NULL, NULL, 'csv-fail: missing header in ' FROM (SELECT DISTINCT campaign FROM calls_raw)
UNION ALL SELECT NULL, NULL, NULL, NULL, 'csv-fail: malformed row in ' FROM (SELECT DISTINCT agent_id FROM calls_raw)""")
def csv_glob_rejects(spark, sf):
    """Uploads of all calls in four layouts (full, columns reversed, a subset in another order, with unknown columns and a comma
    in a value), and all of them again in files without a usable header, one a campaign, and with malformed rows, one an agent;
    a file that can't be read is skipped. File names are cut from the reasons."""
    root = _scratch(spark, "csvglob")
    calls = fx.calls(spark, sf).drop("transcript")
    part = F.col("call_id").cast("bigint") % CSV_PARTS
    columns = [c for c in calls.columns if c not in ("Connected", "Type", "Outcome")]
    extra = calls.withColumn("remark", F.concat(F.lit('so, "'), "campaign", F.lit('"')))
    layouts = {0: columns, 1: columns[::-1], 2: ["agent_id", "call_id"], 3: ["remark", *columns]}
    for k, names in layouts.items():
        io.write_csv(extra.filter(part == k).select(*names), f"{root}/layout{k}")
    io.write_bytes(spark, f"{root}/layout0/part-broken.csv.gz", b"\x1f\x8b\x08\x00 this is no archive")
    odd = calls.select("campaign", "agent_id", "amount").repartition("campaign").withColumn("folder", F.col("campaign"))
    odd.write.partitionBy("folder").csv(f"{root}/bad-heads", header=False)
    line = F.struct(F.lit(1).alias("n"), F.concat_ws(",", "call_id", F.lit("x"), F.lit("one too many")).alias("value"))
    head = F.struct(F.lit(0).alias("n"), F.lit("call_id,agent_id").alias("value"))
    lines = calls.select("agent_id", line.alias("l")).union(calls.select("agent_id", head).distinct()).repartition("agent_id")
    lines.sortWithinPartitions("agent_id", "l.n").select("agent_id", "l.value").write.partitionBy("agent_id").text(f"{root}/bad-rows")
    read, rejects = io.read_calls_csv_glob(spark, f"{root}/{{layout*/part-*,bad-*/*/part-*}}", skip_unreadable=True)
    empty = F.lit(None).cast("string")
    return read.select("call_id", "agent_id", "campaign", r6("amount").alias("amount"), F.lit("included").alias("reason")).unionByName(
        rejects.select(empty.alias("call_id"), empty.alias("agent_id"), empty.alias("campaign"), F.lit(None).cast("double").alias("amount"),
                       F.regexp_replace("reason", " in .*", " in ").alias("reason")))


@register("file_listing", covers="S9 S10 T8", oracle="WITH " + CALLS_RAW_CTE + """,
files AS (SELECT campaign, string_agg(call_id || chr(10), '' ORDER BY call_id) AS content FROM calls_raw GROUP BY campaign)
SELECT campaign AS name, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS found FROM files
UNION ALL SELECT campaign || '.wav', NULL, 'file not found' FROM files""")
def file_listing(spark, sf):
    """One file a campaign with its calls' ids, listed beside files of another kind; recordings of them are asked for in vain."""
    root = _scratch(spark, "media")
    calls = fx.calls(spark, sf).select("campaign", "call_id")
    calls.repartition("campaign").sortWithinPartitions("campaign", "call_id").write.partitionBy("campaign").text(f"{root}/ids")
    calls.write.csv(f"{root}/other")
    listing = io.list_media(spark, root, [".TXT"])
    found = listing.join(io.hash_media(spark, root, ["txt"]).select("path", "sha256"), "path")
    files = found.select(F.regexp_extract("path", "campaign=([^/]+)", 1).alias("name"), F.col("length").alias("size"), F.col("sha256").alias("found"))
    asked = calls.select(F.concat("campaign", F.lit(".wav")).alias("name")).distinct()
    lost = io.missing_files(asked, listing)
    return files.unionByName(lost.select(F.col("call_id").alias("name"), F.lit(None).cast("bigint").alias("size"), F.col("reason").alias("found")))


def _payloads(spark, sf):
    m = fx.messages(spark, sf)
    segs = m.groupBy("call_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("start"), F.col("end"), tx.unicode_trim(F.col("text")).alias("text")))).alias("segments"))
    tr = sg.assemble_transcripts(m, "call_id", ("start",), "text")
    dur = m.groupBy("call_id").agg((F.max("end") - F.min("start") - 1.0).alias("model_d"),
                                   (F.sum(F.length("text")) / 20.0).alias("probe_d"))
    return (tr.join(segs, "call_id").join(dur, "call_id").select(
        F.col("transcript"), F.col("segments"),
        sg.pick_duration(F.col("model_d"), F.col("probe_d")).alias("duration_s"),
        F.lit("base").alias("model"), F.lit("int8").alias("compute"),
        F.struct(F.concat(F.col("call_id"), F.lit(".wav")).alias("name"), F.lit(0).cast("bigint").alias("mtime_ns"),
                 F.length("transcript").cast("bigint").alias("size")).alias("source"),
        F.sha2(F.concat_ws("||", F.lit("stt"), F.col("call_id"), F.lit("base"), F.lit("int8")), 256).alias("key")))


@register("payload_scan", covers="S11 S12 S14 R2", oracle="WITH " + ASSEMBLED_SQL + ",\n" + DURATIONS_SQL + f"""
SELECT a.call_id, {sr6("coalesce(CASE WHEN d.model_d > 0 THEN d.model_d END, d.probe_d, 0.0)")} AS duration_seconds,
       sha256(a.transcript) AS transcript_sha, len({stokens('a.transcript')}) >= 20 AS included
FROM assembled a JOIN durations d ON d.call_id = a.call_id""")
def payload_scan(spark, sf):
    root = _scratch(spark, "payloads")
    io.write_payloads(_payloads(spark, sf), root)
    calls = io.payload_calls(io.read_payloads(spark, root))
    return calls.select("call_id", r6("duration_seconds").alias("duration_seconds"),
                        F.sha2("transcript", 256).alias("transcript_sha"),
                        (tx.token_count("transcript") >= flt.GATE_MIN_TOKENS).alias("included"))


@register("payload_ingest", covers="S14 S10 R3", oracle="WITH " + ASSEMBLED_SQL + f""",
names AS (SELECT call_id, CAST(regexp_extract(call_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM assembled)
SELECT a.call_id, CASE WHEN len({stokens('a.transcript')}) >= 20 THEN 'included' ELSE 'short/non-English' END AS reason
FROM assembled a JOIN names k ON k.call_id = a.call_id WHERE k.n % 7 NOT IN (0, 1)
UNION ALL SELECT call_id || '.wav', 'stt-fail: RuntimeError' FROM names WHERE n % 7 = 0
UNION ALL SELECT call_id || '.wav', 'file not found' FROM names WHERE n % 7 = 1""")
def payload_ingest(spark, sf):
    """Payloads of which one in seven failed and one in seven was requested but never found."""
    p, n = _payloads(spark, sf), F.regexp_extract(F.col("source.name"), r"([0-9]+)\.wav$", 1).cast("bigint") % 7
    held = p.filter(n != 1).withColumn("error", F.when(n == 0, "RuntimeError"))
    calls, rejects = io.ingest_payloads(held, p.select("source.name"))
    return calls.select("call_id", F.lit("included").alias("reason")).unionByName(rejects)


@register("audit_log", covers="S8 T12", oracle=_answer_sql() + """
SELECT row_count, has_offset, n_agents, from_day, count(*) AS entries FROM (
  SELECT s.question_id, count(sc.call_id) AS row_count, TRUE AS has_offset, len(any_value(s.agents)) AS n_agents,
         CAST(any_value(s.date_from) AS VARCHAR) AS from_day
  FROM specs s LEFT JOIN scope sc ON sc.question_id = s.question_id GROUP BY 1)
GROUP BY 1, 2, 3, 4""")
def audit_log(spark, sf):
    from .q_questions import answer_scope, specs
    root = _scratch(spark, "audit")
    sp = staged(specs(spark, sf), "question-specs")             # their scopes and the log read them
    counts = answer_scope(spark, sf, sp=sp).withColumnRenamed("n", "row_count")
    lists = ("type_any", "outcome_any", "agents", "campaigns", "products")
    given = [F.when(F.size(c) > 0, F.col(c)).alias(c) if c in lists else F.col(c)     # keys without a value aren't written
             for c in ("date_from", "date_to", *lists, "min_amount", "max_amount")]
    spec_json = F.to_json(F.struct(*given))
    rows = sp.join(counts, "question_id", "left").select(
        spec_json.alias("filter"), F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
    io.append_audit(rows, root)
    log = io.read_audit(spark, root)
    # the clock itself is dropped; its form and the logged filter are compared
    spec = F.from_json("filter", "date_from string, agents array<string>")
    return log.groupBy("row_count", F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d$").alias("has_offset"),
                       F.size(F.coalesce(spec["agents"], F.array().cast("array<string>"))).cast("bigint").alias("n_agents"),
                       spec["date_from"].alias("from_day")).agg(F.count(F.lit(1)).alias("entries"))


INDEX_LIMIT = 500
INDEX_SQL = DOCS_SQL.rstrip() + """,
lim AS (SELECT * FROM docs_ne{limit})""" + _sparse_sql("lim", "doc_id", "text", "sd") + """
SELECT d.doc_id, sha256(d.text) AS text_sha, any_value(d.m_type) AS type, count(sd.bucket) AS buckets,
       coalesce(sum(sd.bucket), 0) AS bucket_sum, round(coalesce(max(sd.weight), 0), 6) AS top_weight
FROM lim d LEFT JOIN sd ON sd.id = d.doc_id GROUP BY d.doc_id, d.text"""


def _stored(coll):
    total = F.aggregate("vec_idx", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    top = F.coalesce(F.array_max("vec_val"), F.lit(0.0))
    return coll.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.col("metadata")["type"].alias("type"),
                       F.size("vec_idx").cast("bigint").alias("buckets"), total.alias("bucket_sum"), r6(top).alias("top_weight"))


@register("index_build", covers="S13 V5 V6 V7 P14", oracle=INDEX_SQL.replace("{limit}", ""))
def index_build(spark, sf):
    root = _scratch(spark, "collections")
    io.build_index(labeled(spark, sf), root, "calls", DOC_FIELDS, rebuild=True)
    return _stored(io.open_collection(spark, root, "calls"))


@register("index_limit", covers="O8 V6", oracle=INDEX_SQL.replace("{limit}", f" ORDER BY doc_id LIMIT {INDEX_LIMIT}"))
def index_limit(spark, sf):
    root = _scratch(spark, "collections")
    io.build_index(labeled(spark, sf), root, "calls", DOC_FIELDS, limit=INDEX_LIMIT, rebuild=True)
    return _stored(io.open_collection(spark, root, "calls"))


@register("index_update", covers="V5 V6 J6 S13", oracle=DOCS_SQL.rstrip() + """,
upd AS (SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 1 THEN text || chr(10) || 'v2' ELSE text END AS text, m_type FROM docs_ne),
lim AS (SELECT * FROM upd)""" + _sparse_sql("lim", "doc_id", "text", "sd") + """
SELECT d.doc_id, sha256(d.text) AS text_sha, any_value(d.m_type) AS type, count(sd.bucket) AS buckets,
       coalesce(sum(sd.bucket), 0) AS bucket_sum, round(coalesce(max(sd.weight), 0), 6) AS top_weight
FROM lim d LEFT JOIN sd ON sd.id = d.doc_id GROUP BY d.doc_id, d.text""")
def index_update(spark, sf):
    """A first build of two thirds of the calls, then an update that replaces one third and adds the rest."""
    root = _scratch(spark, "collections")
    calls, n = staged(labeled(spark, sf), "labeled"), F.col("call_id").cast("bigint") % 3      # three builds read them
    io.build_index(calls.filter(n != 2), root, "calls", DOC_FIELDS, rebuild=True)
    io.build_index(calls.filter(n == 2), root, "calls", DOC_FIELDS)
    changed = calls.filter(n == 1).withColumn("note", F.lit("v2"))
    io.build_index(changed, root, "calls", (*DOC_FIELDS, "note"))
    return _stored(io.open_collection(spark, root, "calls"))


@register("stream_ingest", covers="X1 W1", oracle=BATCHES_SQL + f""",
g AS (SELECT * FROM batches WHERE len({stokens('transcript')}) >= 20)
SELECT call_id, {sfmt('start_time')} AS start_time, {sr6('amount')} AS amount, 'included' AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY call_id, start_time ORDER BY batch DESC) AS rn FROM g)
WHERE rn = 1
UNION ALL SELECT DISTINCT call_id, NULL, NULL, 'short/non-English' || ' ' || CAST(batch - 1 AS VARCHAR) FROM batches
WHERE len({stokens('transcript')}) < 20""")
def stream_ingest(spark, sf):
    root = _scratch(spark, "stream")
    landing, snap, rej, ck = f"{root}/landing", f"{root}/calls", f"{root}/rejects", f"{root}/checkpoint"
    b = fx.batches(spark, sf)
    for n in (1, 2):
        b.filter(F.col("batch") == n).drop("batch").write.mode("append").parquet(landing)
        q = ingest.start_ingest(spark, landing, snap, rej, ck)
        q.awaitTermination()
    out = io.load_snapshot(spark, snap)
    rejects = spark.read.parquet(rej).select(
        "call_id", F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("double").alias("amount"),
        F.concat_ws(" ", "reason", F.col("batch").cast("string")).alias("reason"))
    return out.select("call_id", fmt_ts("start_time").alias("start_time"), r6("amount").alias("amount"),
                      F.lit("included").alias("reason")).unionByName(rejects)
