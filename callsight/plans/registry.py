"""Query registry: each entry pairs a Spark plan with its DuckDB oracle SQL."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: Optional[str]
    covers: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: Optional[str] = None, covers: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)                       # UTC session time zone for every query
            return fn(spark, sf_dir)
        REGISTRY[name] = Query(name, build, oracle, covers)
        return fn
    return deco
