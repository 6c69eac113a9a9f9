"""Shared derived frames and result conventions for registered queries.

Result conventions (shared with the oracle SQL): doubles rounded to 6 digits,
timestamps rendered as 'yyyy-MM-dd HH:mm:ss' text, session time zone UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import labels as lab
from . import fixtures as fx
from . import oracle_sql as osql

LABEL_RULES = fx.TEST_RULES


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def fmt_ts(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def gated(spark: SparkSession, sf: str, keep_tokens: bool = False):
    return flt.gate(fx.calls_with_raw_labels(spark, sf), keep_tokens=keep_tokens)


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    """Gate -> rules (test profile). Raw user labels are replaced by rule labels."""
    inc, _ = gated(spark, sf, keep_tokens=True)
    return lab.apply_labels(inc, LABEL_RULES)


def labeled_preferring(spark: SparkSession, sf: str) -> DataFrame:
    """Gate -> P3-normalized user labels -> rules -> prefer user labels."""
    from ..operators.normalize import normalize_labels
    inc, _ = gated(spark, sf)
    return lab.relabel(normalize_labels(inc), LABEL_RULES)


# SQL prefix defining calls_raw, gated, labeled (test rules on gated calls).
LABELED_SQL = osql.labeled_calls_sql(LABEL_RULES)
