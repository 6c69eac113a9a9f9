"""A filter of bounded size that tells which rows an id list can't concern.

A Bloom filter of the ids, at most ``MAX_BITS`` (8 MB), is broadcast; rows that it rules out take a
way without a shuffle, the others, some wrongly let through, the exact join. Where a list is so long
that the filter lets everything through, all rows take the join: the result never depends on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix

MIN_BITS, MAX_BITS, BITS_PER_ID, HASHES = 1 << 20, 1 << 26, 16, 3


def _places(ids: np.ndarray, bits: int):
    with np.errstate(over="ignore"):
        for k in range(1, HASHES + 1):
            yield mix(ids.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(bits - 1)


class Probe:
    """Built from a frame with one long column."""

    def __init__(self, ids: DataFrame):
        ids = ids.toDF("id").where("id is not null")
        wanted = max(1, ids.count()) * BITS_PER_ID
        bits = min(MAX_BITS, max(MIN_BITS, 1 << int(wanted - 1).bit_length()))

        def run(batches):
            words = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                for place in _places(batch.column(0).to_numpy(), bits):
                    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            some = np.flatnonzero(words)
            yield pa.record_batch([pa.array(some), pa.array(words[some].view(np.int64))], ["word", "value"])

        rows = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
        self.shared, self.bits = ids.sparkSession.sparkContext.broadcast(words), bits

    def maybe(self, column: str) -> Column:
        """Whether a row's id may be on the list; null ids may."""
        shared, bits = self.shared, self.bits

        @F.arrow_udf("boolean")
        def maybe(ids: pa.Array) -> pa.Array:
            return pa.array(_mask(shared.value, bits, ids))

        return maybe(F.col(column))

    def keep(self, wanted: bool):
        """For mapInArrow: the rows whose first column may be on the list, or those for which it can't."""
        shared, bits = self.shared, self.bits

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(_mask(shared.value, bits, batch.column(0)) == wanted))

        return run


def _mask(words: np.ndarray, bits: int, ids: pa.Array) -> np.ndarray:
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.ones(len(known), bool)
    for place in _places(known, bits):
        out &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out | ids.is_null().to_numpy(zero_copy_only=False)


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not on the list (null ids stay). ids: one long column, a written table."""
    maybe = Probe(ids).maybe(column)
    listed = ids.toDF("_listed").distinct()
    suspect = rows.where(maybe)
    return rows.where(~maybe).union(suspect.join(listed, suspect[column] == listed["_listed"], "left_anti"))


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id, their first column, is on the list. ids: one long column, a written table.

    The few rows that may be are shuffled: what follows runs in a stage, and so in Python workers, of its own."""
    suspect = rows.mapInArrow(Probe(ids).keep(True), rows.schema)
    listed = ids.toDF("_listed").distinct().hint("merge")
    return suspect.join(listed, suspect[column] == listed["_listed"], "left_semi")
