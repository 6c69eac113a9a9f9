"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary (Spark's mergeable frequent-items sketch) of the text digests names
the candidates for frequent digests; their exact counts and winners, at most ``top`` rows,
are broadcast, and their copies leave on the map side without a shuffle. The other digests,
none of which holds more than about 1/``top`` of the rows, are shuffled and ranked as usual.

Equal means identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
the largest doc_id stays (null ids rank last); of repeated rows with that id exactly one stays.
Empty tables give empty results; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: rows broadcast at most, and digests that the summary tracks
TOP, TRACKED = 512, 8192

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the text with A-Z lowered, null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), 256)


def heavy_winners(digests: DataFrame, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """Exact group size and winner of the frequent digests: (digest, heavy_id, heavy_size), at most ``top`` rows."""
    found = digests.agg(F.expr(f"approx_top_k(digest, {int(top)}, {int(tracked)})").alias("items"))
    frequent = found.select(F.explode("items").alias("i")).select(F.col("i.item").alias("digest"))
    return (digests.join(F.broadcast(frequent), "digest", "left_semi")
            .groupBy("digest").agg(F.max("id").alias("heavy_id"), F.count(F.lit(1)).alias("heavy_size"))
            .where("heavy_size > 1"))


def _ranked(ordinary: DataFrame) -> DataFrame:
    """Rows of digests that no heavy group holds, and the winners' rows of those that one does."""
    group = Window.partitionBy("digest")
    return ordinary.select(
        "*",
        F.coalesce("heavy_id", F.max("id").over(group)).alias("keep_id"),
        F.coalesce("heavy_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("id").desc_nulls_last())) == 1).alias("kept"),
    )


def mark(docs: DataFrame, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = stage(docs.select(F.col("doc_id").alias("id"), text_digest("text").alias("digest")), "exact-digests")
    heavy = stage(heavy_winners(digests, top, tracked), "exact-heavy")
    rows = digests.join(F.broadcast(heavy), "digest", "left")
    loses = F.col("heavy_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("heavy_id"))
    removed = rows.where(loses).select("id", "heavy_id", "heavy_size", F.lit(False).alias("kept"), "digest")
    ranked = _ranked(rows.where(~loses)).select("id", "keep_id", "group_size", "kept", "digest")
    return removed.union(ranked).toDF("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """The documents that stay, with all their columns."""
    packed = docs.select(F.col("doc_id").alias("id"), text_digest("text").alias("digest"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    heavy = stage(heavy_winners(stage(packed.select("id", "digest"), "exact-digests"), top, tracked), "exact-heavy")
    rows = packed.join(F.broadcast(heavy), "digest", "left")
    staying = rows.where(F.col("heavy_size").isNull() | F.col("id").eqNullSafe(F.col("heavy_id")))
    return _ranked(staying).where("kept").select("row.*")
