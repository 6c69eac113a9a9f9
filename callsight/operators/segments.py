"""Transcript assembly from timed segments, and speaker-segment building / clean-up.

Window labels -> segments is a gaps-and-islands computation; the clean-up fold of
the reference (merge into the previous segment when the speaker repeats or the
segment is tiny, then a monotonic clamp) is re-expressed with window functions:

* a segment opens a new merged segment iff it is the first one, or it is not tiny
  and its speaker differs from the speaker of the latest non-tiny (or first) segment
  before it — that speaker is exactly the speaker of the open merged segment;
* merged segments are a group-by over the running count of openings;
* ends and counts run along a recording as segmented scans (``scan``): windows hold one range of places of a
  recording, so a recording of any length is spread over tasks;
* the clamp cursor is the running maximum of earlier merged ends (merged segments
  ending within 1 ms of the cursor are the only ones dropped, so this equals the
  fold's cursor up to that 1 ms tolerance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import scan

# --- fixed values: speaker segmentation defaults ---
WINDOW_S = 1.5
HOP_S = 0.75
MIN_SEGMENT_S = 0.75
MIN_KEEP_S = 1e-3
# --- end fixed values ---

#: stretch of time whose segments are joined at once
CHUNK_S = 600.0
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def assemble_transcripts(segments: DataFrame, key: str = "call_id", order: tuple = ("start",),
                         text_col: str = "text", chunk: float = CHUNK_S) -> DataFrame:
    """Per key, stripped non-empty segment texts in time order joined by one space.

    Segments are joined to the text of their stretch of ``chunk`` units of the first order column, and the texts of the
    stretches to the transcript: no row holds all segments of a call, only its transcript."""
    st = F.struct(*[F.col(c) for c in order], tx.unicode_trim(F.col(text_col)).alias("_t"))
    first = F.col(order[0])
    kind = dict(segments.dtypes)[order[0]]
    place = F.unix_seconds(first) if kind == "timestamp" else first if kind in _NUMERIC or kind.startswith("decimal") else F.lit(0)
    cut = segments.withColumn("_c", F.floor(place / F.lit(float(chunk))))
    g = cut.groupBy(key, "_c").agg(F.array_sort(F.collect_list(st)).alias("_s"))
    texts = F.filter(F.transform("_s", lambda s: s["_t"]), lambda t: t.isNotNull() & (t != ""))
    stretches = g.select(key, F.struct("_c", F.array_join(texts, " ").alias("_t")).alias("_p"))
    g = stretches.groupBy(key).agg(F.array_sort(F.collect_list("_p")).alias("_s"))
    texts = F.filter(F.transform("_s", lambda p: p["_t"]), lambda t: t != "")
    return g.select(key, tx.unicode_trim(F.array_join(texts, " ")).alias("transcript"))


def pick_duration(model_duration: Column, probe_duration: Column) -> Column:
    """R2: model duration when positive, else the probed duration, else 0."""
    return F.coalesce(F.when(model_duration > 0, model_duration), probe_duration, F.lit(0.0))


def speaker_of(label: Column) -> Column:
    """0 -> 'A', 1 -> 'B', ... (label modulo 26)."""
    return F.char(F.lit(65) + F.pmod(label, F.lit(26)))


def window_segments(labels: DataFrame, key: str, idx: str = "i", label: str = "label",
                    win: float = WINDOW_S, hop: float = HOP_S) -> DataFrame:
    """Consecutive equal window labels -> (key, seg, start, end, speaker).

    start = first index * hop; a segment followed by another ends at
    max(start + hop, next_first * hop + win); the last ends at (n-1) * hop + win."""
    w = scan.inside((key,), idx)
    cut = scan.ranged(labels, F.col(idx))
    inner = F.when(F.row_number().over(w) == 1, 0).when(F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label)), 1).otherwise(0)
    cut = cut.withColumn("_new", inner).withColumn("_next", F.lead(idx).over(w))
    cut = scan.handed(cut, (key,), {"_at": F.min(idx), "_head": F.min_by(label, idx), "_tail": F.max_by(label, idx), "_inner": F.sum("_new")},
                      lambda before, order: {"_at": F.col("_at"), "_after": F.lead("_at").over(order), "_inner": F.col("_inner"),
                                             "_opens": F.when(F.lag("_tail").over(order).isNull() | (F.lag("_tail").over(order) != F.col("_head")), 1)
                                             .otherwise(0)})
    # a range's first window opens a segment if it differs from the last of the range before
    cut = scan.handed(cut, (key,), {"_mine": F.max(F.col("_inner") + F.col("_opens"))},
                      lambda before, _: {"_before": F.coalesce(F.sum("_mine").over(before), F.lit(0))})
    running = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    isl = cut.withColumn("seg", F.col("_before") + F.col("_opens") + running)
    runs = isl.groupBy(key, "seg").agg(F.min(idx).alias("_first"), F.max(idx).alias("_last"), F.first(label).alias("_label"),
                                       F.max_by(F.coalesce("_next", "_after"), idx).alias("_nxt"))
    nxt = F.col("_nxt")
    start = F.col("_first") * hop
    end = F.when(nxt.isNull(), F.col("_last") * hop + win).otherwise(
        F.greatest(start + hop, nxt * hop + win))
    return runs.select(key, "seg", start.alias("start"), end.alias("end"),
                       speaker_of(F.col("_label")).alias("speaker"))


def clean_segments(segs: DataFrame, key: str, seq: str = "seg",
                   min_segment_s: float = MIN_SEGMENT_S) -> DataFrame:
    """Merge repeated-speaker and tiny segments into the previous one, then clamp to a
    monotonic timeline, drop (near) empty ones and round to 2 digits."""
    w = scan.inside((key,), seq)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    cut = scan.ranged(segs.withColumn("_tiny", (F.col("end") - F.col("start")) < min_segment_s), F.col(seq))
    cut = scan.handed(cut, (key,), {"_at": F.min(seq), "_head": F.min_by("speaker", seq), "_tail": F.max_by("speaker", F.when(~F.col("_tiny"), F.col(seq)))},
                      lambda before, order: {
                          "_start": F.when(F.row_number().over(order) == 1, F.col("_at")),
                          # a recording's first segment is an anchor even if it is tiny
                          "_anchor": F.coalesce(F.last("_tail", ignorenulls=True).over(before), F.first("_head").over(before))})
    cut = cut.withColumn("_first", F.coalesce(F.col(seq) == F.col("_start"), F.lit(False)))
    anchor_spk = F.when(F.col("_first") | ~F.col("_tiny"), F.col("speaker"))
    prev_anchor = F.coalesce(F.last(anchor_spk, ignorenulls=True).over(earlier), F.col("_anchor"))
    cut = cut.withColumn("_open", (F.col("_first") | (~F.col("_tiny") & (F.col("speaker") != prev_anchor))).cast("int"))
    cut = scan.handed(cut, (key,), {"_opened": F.sum("_open")}, lambda before, _: {"_before": F.coalesce(F.sum("_opened").over(before), F.lit(0))})
    running = F.coalesce(F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    cut = cut.withColumn("_m", F.col("_before") + running)
    merged = cut.groupBy(key, "_m").agg(F.min_by("start", seq).alias("start"), F.max("end").alias("end"),
                                        F.min_by("speaker", seq).alias("speaker"))
    merged = scan.handed(scan.ranged(merged, F.col("_m")), (key,), {"_end": F.max("end")}, lambda before, _: {"_so_far": F.max("_end").over(before)})
    # greatest skips nulls
    cursor = F.coalesce(F.greatest(F.max("end").over(scan.inside((key,), "_m").rowsBetween(Window.unboundedPreceding, -1)), F.col("_so_far")), F.lit(0.0))
    st = F.greatest(cursor, F.col("start"))
    en = F.greatest(st, F.col("end"))
    out = merged.select(key, F.col("_m").alias("seg"), st.alias("start"), en.alias("end"), "speaker")
    return (out.filter(F.col("end") - F.col("start") > MIN_KEEP_S)
               .select(key, "seg", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"),
                       "speaker"))
