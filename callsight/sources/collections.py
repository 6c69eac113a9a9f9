"""Stored inverted lists: the rows in one partition folder a list, and a table that describes the lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ivf
from . import io

#: rows of one file of a list, about
FILE_ROWS = 1 << 20


def save_lists(index: DataFrame, root: str, name: str, metric: str = "cosine", lists: int | None = None) -> ivf.Lists:
    """Fit, assign and store the lists of an index (doc_id, vector); returns their description.

    The rows are written first; the description, which names their folder, is published last. A list
    is dealt over as many files as its size asks for, so one large list is no single task."""
    spark = index.sparkSession
    centroids = ivf.fit(index, metric, lists)
    rows = ivf.assign(index, centroids, metric)
    found = ivf.described(rows, centroids, metric)
    files = spark.createDataFrame([(k, max(1, -(-int(n) // FILE_ROWS))) for k, n in enumerate(found.sizes)], "list int, files int")
    dealt = rows.join(F.broadcast(files), "list").withColumn("file", F.pmod(F.xxhash64("doc_id"), F.col("files")))
    base = f"{root.rstrip('/')}/{name}"
    folder = io.save_snapshot(dealt.repartition("list", "file").select("doc_id", "vector", "list"), f"{base}/rows", ["list"])
    table = [(k, metric, folder, found.centroids[k].tolist(), float(found.radii[k]), int(found.sizes[k])) for k in range(len(found.sizes))]
    described = spark.createDataFrame(table, "list int, metric string, folder string, centroid array<double>, radius double, rows long")
    io.save_snapshot(described.coalesce(1), f"{base}/lists")
    return found


def open_lists(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, ivf.Lists] | None:
    """The stored rows and the description of their lists; None before the first save."""
    base = f"{root.rstrip('/')}/{name}"
    path = io._current(spark, f"{base}/lists")
    if path is None:
        return None
    table = spark.read.parquet(path).orderBy("list").collect()
    found = ivf.Lists(table[0]["metric"], np.array([r["centroid"] for r in table]), np.array([r["radius"] for r in table]),
                      np.array([r["rows"] for r in table]))
    rows = spark.read.schema("doc_id string, vector array<double>, list int").parquet(table[0]["folder"])
    return rows, found
