"""Set and merge operators: union of batches, keep-last, anti-join increments, upsert, delete."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from ..functions import text as tx

CALL_KEY = ("call_id", "start_time")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, key: Sequence[str] = CALL_KEY, order: Sequence[str] = ("batch",)) -> DataFrame:
    """One row per key — the one with the greatest ``order`` (later batch, then later row).

    ``order`` should be total: give the batch first, then what orders rows inside it (upload
    time, file, row number). Rows that still tie are ordered by a hash of all their values, so the
    result never depends on how the input was split. ``row_number() = 1`` lets Spark insert a
    partial WindowGroupLimit before the shuffle, so each map task forwards at most one row per
    key: a key duplicated across a third of the input does not pile up in one reducer. Null key
    parts group together (same as the reference's de-dup).
    """
    plain = [F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*plain).desc())
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn"))


def new_only(candidates: DataFrame, processed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates whose key is not yet in ``processed`` (left anti join)."""
    return candidates.join(processed.select(*key).distinct(), list(key), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str = "doc_id",
           order: str | None = None) -> DataFrame:
    """Replace rows with the same id, add new ids (anti join + union).
    With ``order``, duplicate ids inside ``new`` keep the row with the greatest order."""
    if order is not None:
        new = keep_last(new, (key,), (order,))
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete_ids(existing: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop rows whose id is listed."""
    return existing.join(ids.select(key), key, "left_anti")


def transcript_key(text_col: str = "transcript"):
    """Content identity of a transcript."""
    return tx.sha256_hex(F.coalesce(F.col(text_col), F.lit("")))


def _key(*parts):
    return tx.sha256_hex(F.concat_ws("||", *[p if not isinstance(p, (str, int, float)) else F.lit(str(p)) for p in parts]))


def media_key(source: str = "source", model: str = "model", compute: str = "compute"):
    """Identity of a transcription: file name, modification time, size, model and compute type.
    An edited file or another model is new; a copy under the same identity is not."""
    fields = [F.col(f"{source}.{f}").cast("string") for f in ("name", "mtime_ns", "size")]
    return _key("stt", *fields, F.col(model), F.col(compute))


def labels_key(rules, text_col: str = "transcript"):
    """Identity of a call's labels: its text and the rule parameters that decide them."""
    return _key("labels", transcript_key(text_col), f"cut={rules.duration_cutoff_s}", f"tok={rules.min_tokens}",
                f"tail={rules.outcome_window_frac}")
