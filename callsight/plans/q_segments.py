"""Registered queries: transcript assembly, durations, speaker segments, batch pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import labels as lab
from ..operators import merge as mg
from ..operators import scan
from ..operators import segments as sg
from . import fixtures as fx
from .common import LABEL_RULES, LABELED_SQL
from .oracle_sql import label_ctes, r6 as sr6, tokens as stokens
from .registry import register

WS = tx.WS_CLASS


def _trim_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


ASSEMBLED_SQL = f"""assembled AS (
  SELECT CAST(conv_id AS VARCHAR) AS call_id,
         {_trim_sql("coalesce(string_agg(" + _trim_sql('text') + ", ' ' ORDER BY turn) FILTER (WHERE " + _trim_sql('text') + " <> ''), '')")}
           AS transcript
  FROM conversations GROUP BY conv_id)"""


@register("assemble_transcripts", covers="R1", oracle="WITH " + ASSEMBLED_SQL + """
SELECT call_id, sha256(transcript) AS transcript_sha, length(transcript) AS n_chars FROM assembled""")
def assemble_transcripts(spark, sf):
    t = sg.assemble_transcripts(fx.messages(spark, sf), "call_id", ("start",), "text")
    return t.select("call_id", F.sha2("transcript", 256).alias("transcript_sha"),
                    F.length("transcript").alias("n_chars"))


DURATIONS_SQL = """durations AS (
  SELECT CAST(conv_id AS VARCHAR) AS call_id,
         CAST(max(turn) + 1 - min(turn) AS DOUBLE) - 1.0 AS model_d,
         sum(length(text)) / 20.0 AS probe_d
  FROM conversations GROUP BY conv_id)"""


def _durations(spark, sf):
    m = fx.messages(spark, sf)
    return m.groupBy("call_id").agg((F.max("end") - F.min("start") - 1.0).alias("model_d"),
                                    (F.sum(F.length("text")) / 20.0).alias("probe_d"))


@register("durations", covers="R2", oracle="WITH " + DURATIONS_SQL + f"""
SELECT call_id, {sr6("coalesce(CASE WHEN model_d > 0 THEN model_d END, probe_d, 0.0)")} AS duration_seconds
FROM durations""")
def durations(spark, sf):
    d = _durations(spark, sf)
    return d.select("call_id", F.round(sg.pick_duration(F.col("model_d"), F.col("probe_d")), 6)
                    .alias("duration_seconds"))


def event_labels(spark, sf):
    """Window labels per recording: a recording is one user's events in time order. Label = index of
    the event type among the sorted distinct types; i = window position inside the recording."""
    ev = fx.table(spark, sf, "events")
    types = ev.select(F.array_sort(F.collect_set("event_type"))).scalar()
    ev = ev.withColumn("recording_id", F.col("user_id").cast("string"))
    # by days, so that a recording with very many events is numbered in several tasks
    ev = scan.numbered(ev, ("recording_id",), F.unix_seconds(F.col("ts").cast("timestamp")), ("ts", "event_id"), "i", 86_400)
    return ev.select(F.col("recording_id"), "i",
                     (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("label"))


SEG_SQL = f"""rec AS (SELECT *, CAST(user_id AS VARCHAR) AS rec_id FROM events),
lab AS (
  SELECT rec_id AS recording_id,
         row_number() OVER (PARTITION BY rec_id ORDER BY ts, event_id) - 1 AS i,
         list_position((SELECT list_sort(list(DISTINCT event_type)) FROM events), event_type) - 1 AS label
  FROM rec),
flag AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording_id ORDER BY i) IS NULL
                          OR lag(label) OVER (PARTITION BY recording_id ORDER BY i) <> label THEN 1 ELSE 0 END AS nw
         FROM lab),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
        FROM flag),
runs AS (SELECT recording_id, seg, min(i) AS f, max(i) AS l, min(label) AS label FROM isl GROUP BY 1, 2),
segs AS (
  SELECT recording_id, seg, f * {sg.HOP_S} AS start,
         CASE WHEN lead(f) OVER (PARTITION BY recording_id ORDER BY seg) IS NULL THEN l * {sg.HOP_S} + {sg.WINDOW_S}
              ELSE greatest(f * {sg.HOP_S} + {sg.HOP_S}, lead(f) OVER (PARTITION BY recording_id ORDER BY seg) * {sg.HOP_S} + {sg.WINDOW_S}) END AS "end",
         chr(CAST(65 + label % 26 AS INTEGER)) AS speaker
  FROM runs)"""


def _window_segments(spark, sf):
    return sg.window_segments(event_labels(spark, sf), "recording_id", "i", "label")


@register("window_segments", covers="W3", oracle="WITH " + SEG_SQL + """
SELECT recording_id, seg, round(start, 6) AS start, round("end", 6) AS "end", speaker FROM segs""")
def window_segments(spark, sf):
    s = _window_segments(spark, sf)
    return s.select("recording_id", "seg", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"),
                    "speaker")


def _fold_sql(min_segment_s: float) -> str:
    """W4 as a plain fold, one segment after another (recursive), then the clamp, one merged segment after another."""
    merge = f"""(s.speaker = f.speaker OR s."end" - s.start < {min_segment_s})"""
    return "WITH RECURSIVE " + SEG_SQL + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg) AS n FROM segs),
fold AS (
  SELECT recording_id, n, 1 AS m, start, "end", speaker FROM numbered WHERE n = 1
  UNION ALL
  SELECT s.recording_id, s.n, CASE WHEN {merge} THEN f.m ELSE f.m + 1 END, CASE WHEN {merge} THEN f.start ELSE s.start END,
         CASE WHEN {merge} THEN greatest(f."end", s."end") ELSE s."end" END, CASE WHEN {merge} THEN f.speaker ELSE s.speaker END
  FROM fold f JOIN numbered s ON s.recording_id = f.recording_id AND s.n = f.n + 1),
merged AS (SELECT recording_id, m, arg_max(start, n) AS start, arg_max("end", n) AS "end", arg_max(speaker, n) AS speaker
           FROM fold GROUP BY 1, 2),
clamp AS (
  SELECT recording_id, m, greatest(0.0, start) AS st, greatest(greatest(0.0, start), "end") AS en, speaker FROM merged WHERE m = 1
  UNION ALL
  SELECT x.recording_id, x.m, greatest(c.en, x.start), greatest(greatest(c.en, x.start), x."end"), x.speaker
  FROM clamp c JOIN merged x ON x.recording_id = c.recording_id AND x.m = c.m + 1)
SELECT recording_id, m AS seg, round(st, 2) AS start, round(en, 2) AS "end", speaker FROM clamp WHERE en - st > {sg.MIN_KEEP_S}"""


@register("clean_segments", covers="W4", oracle=_fold_sql(sg.MIN_SEGMENT_S))
def clean_segments(spark, sf):
    return sg.clean_segments(_window_segments(spark, sf), "recording_id", "seg")


@register("clean_segments_tiny", covers="W4", oracle=_fold_sql(2.3))
def clean_segments_tiny(spark, sf):
    """A longer least segment, so that single windows are tiny and join the segment before them."""
    return sg.clean_segments(_window_segments(spark, sf), "recording_id", "seg", 2.3)


@register("batch_pipeline", covers="R3 S14 U1 A15", oracle=LABELED_SQL.rstrip() + ",\n" + ASSEMBLED_SQL + ",\n"
          + DURATIONS_SQL + f""",
conv_calls AS (
  SELECT a.call_id, NULL::TIMESTAMP AS start_time,
         coalesce(CASE WHEN d.model_d > 0 THEN d.model_d END, d.probe_d, 0.0) AS duration_seconds,
         a.transcript
  FROM assembled a JOIN durations d ON d.call_id = a.call_id),
conv_gated AS (SELECT * FROM conv_calls WHERE len({stokens('transcript')}) >= 20),
{label_ctes(LABEL_RULES, source='conv_gated', name='conv_labeled')},
allc AS (SELECT Connected FROM labeled UNION ALL SELECT Connected FROM conv_labeled)
SELECT count(*) AS included,
       count(*) FILTER (WHERE Connected = 'Connected') AS connected,
       count(*) FILTER (WHERE Connected = 'Disconnected') AS disconnected,
       (SELECT count(*) FROM calls_raw WHERE len({stokens('transcript')}) < 20)
       + (SELECT count(*) FROM conv_calls WHERE len({stokens('transcript')}) < 20) AS excluded
FROM allc""")
def batch_pipeline(spark, sf):
    """Uploaded call rows + transcribed conversations -> gate -> union -> label -> report."""
    csv_calls = fx.calls(spark, sf)
    conv = sg.assemble_transcripts(fx.messages(spark, sf), "call_id", ("start",), "text")
    d = _durations(spark, sf)
    conv_calls = conv.join(d, "call_id").select(
        "call_id", F.lit(None).cast("timestamp").alias("start_time"),
        sg.pick_duration(F.col("model_d"), F.col("probe_d")).alias("duration_seconds"), "transcript")
    inc1, exc1 = flt.gate(csv_calls)
    inc2, exc2 = flt.gate(conv_calls)
    included = lab.apply_labels(mg.union_all([inc1, inc2]), LABEL_RULES)
    return agg.batch_report(included, mg.union_all([exc1, exc2]))
