"""Running values along an order, in parallel: a segmented prefix scan.

The rows of a key are cut into ranges of their order. Each range is scanned by a window of its own; what it hands on
(a count, its last value, its greatest one) is one row, and a window over a key's ranges gives every range what the
ranges before and after it hand over. No task holds more of a key than one range, however long the key is.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: places of a range
RANGE = 4096


def ranged(rows: DataFrame, place: Column, size: int | None = None) -> DataFrame:
    """Rows with their range ``_r``: ``size`` consecutive places each."""
    return rows.withColumn("_r", F.floor(place / F.lit(float(size or RANGE))).cast("bigint"))


def inside(keys: Sequence[str], *order):
    """The window of a range."""
    return Window.partitionBy(*keys, "_r").orderBy(*order)


def handed(rows: DataFrame, keys: Sequence[str], gives: Mapping[str, Column], takes) -> DataFrame:
    """Rows with what their range takes from the others of its key.

    gives: aggregates over a range, by name; takes: a function of two windows over a key's ranges, of those before
    and of all in order, to columns over the names in ``gives``."""
    per = rows.groupBy(*keys, "_r").agg(*[c.alias(n) for n, c in gives.items()])
    in_order = Window.partitionBy(*keys).orderBy("_r")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    taken = takes(before, in_order)
    names = [f"_key{n}" for n in range(len(keys) + 1)]
    per = per.select(*[F.col(k).alias(n) for k, n in zip((*keys, "_r"), names)], *[c.alias(n) for n, c in taken.items()])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip((*keys, "_r"), names)])
    return rows.join(per, same).drop(*names)


def numbered(rows: DataFrame, keys: Sequence[str], place: Column, order: Sequence, name: str = "n", size: int | None = None) -> DataFrame:
    """Rows with their number in their key, from 0 in ``order``; ``place`` grows with the order."""
    cut = ranged(rows, place, size)
    cut = handed(cut, keys, {"_rows_in": F.count(F.lit(1))}, lambda before, _: {"_before": F.coalesce(F.sum("_rows_in").over(before), F.lit(0))})
    return cut.withColumn(name, F.col("_before") + F.row_number().over(inside(keys, *order)) - 1).drop("_r", "_before")
