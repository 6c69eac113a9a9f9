"""Shards of near-equal bytes by a k-d tree over document metadata.

Every document is a point whose coordinates are its metadata columns (numbers as they are, categories
by hash), each scaled to [0, 2**20) over the whole table. Cells are split at the weighted median of
their widest dimension, all cells of a level at once, until each leaf holds one shard's share of the
bytes. Medians are found by counting bytes in 1,024 bins of the cell's key range and looking closer
at the bin that holds the median, so the driver sees at most 1,024 sums per cell and round.

Equal texts form one point (that of their smallest doc_id) and so share a shard, unless a group
alone holds over 1/8 of a shard's bytes: such groups (at most 8 for each shard) are dealt by row.
Ties in a dimension are ordered by a hash of the text, and for dealt groups of the row.

Law: ``bytes``. A size is the text's UTF-8 bytes (null: none) plus 1. Slots count a shard's rows from 0,
by chunks of bounded size. Null ids and metadata sort lowest; repeated rows are placed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage

SHARDS = 16
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
#: a group of equal texts is dealt by row when it holds more than this share of a shard
HOT_SHARE = 1 / 8
BINS, CHUNK_ROWS = 1024, 50_000
_SCALE, _TIES = 1 << 20, 1 << 41


def _coordinate(docs: DataFrame, name: str) -> Column:
    kind = docs.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(_SCALE)).cast("double")


def _points(docs: DataFrame, dimensions: tuple[str, ...], shards: int) -> DataFrame:
    """A written table of rows: row, doc_id, size, crc, c0.., tie."""
    names = [f"x{k}" for k in range(len(dimensions))]
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.sha2(text, 256).alias("digest"),
        *[_coordinate(docs, d).alias(n) for d, n in zip(dimensions, names)]), "shard-rows")
    ends = rows.agg(F.sum("size").alias("bytes"),
                    *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    hot_bytes = (ends["bytes"] or 0) / shards * HOT_SHARE

    def scaled(name: str) -> Column:
        low, high = ends[f"min_{name}"] or 0.0, ends[f"max_{name}"] or 0.0
        return F.coalesce(F.floor((F.col(name) - low) / F.lit((high - low) or 1.0) * (_SCALE - 1)), F.lit(0)).cast("long")

    coords = [scaled(n).alias(f"c{k}") for k, n in enumerate(names)]
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                                        F.min(F.struct("doc_id", "row", *names)).alias("first"))
    hot = groups.where((F.col("bytes") > hot_bytes) & (F.col("n") > 1)).select("digest", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    dealt = rows.where("hot").select("row", "doc_id", "size", "crc", *coords, F.xxhash64("digest", "row").alias("tie"))
    # a group of one is its own first row; the others learn their first row by digest, no group being hot
    placed = (rows.where("hot is null").drop(*names).join(groups.select("digest", "first.*").drop("doc_id", "row"), "digest")
              .select("row", "doc_id", "size", "crc", *coords, F.xxhash64("digest").alias("tie")))
    return stage(dealt.union(placed).withColumn("tie", F.pmod("tie", F.lit(_TIES))), "shard-points")


def _of_cell(values: dict[int, int], cells: int, other: int = 0) -> Column:
    """The number that a row's cell has."""
    return F.array(*[F.lit(values.get(k, other)).cast("long") for k in range(cells)])[F.col("cell")]


def _key(widest: dict[int, int], cells: int, dimensions: int) -> Column:
    """A row's place along its cell's widest dimension, ties in order of their hash."""
    coordinate = F.array(*[F.col(f"c{d}") for d in range(dimensions)])[_of_cell(widest, cells).cast("int")]
    return coordinate * F.lit(_TIES) + F.col("tie")


def _cuts(rows: DataFrame, cells: int, share: dict[int, float]) -> dict[int, int]:
    """The key from which each cell's upper part begins. rows: cell, key, size; share: of the bytes below it."""
    ends = {r["cell"]: r for r in rows.groupBy("cell").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("n")).collect() if r["cell"] in share}
    span = {k: (r["lo"], r["hi"]) for k, r in ends.items()}
    goal = {k: r["n"] * share[k] for k, r in ends.items()}
    out: dict[int, int] = {}
    while span:
        width = {k: max(1, -(-(hi - lo + 1) // BINS)) for k, (lo, hi) in span.items()}
        lo = _of_cell({k: x for k, (x, _) in span.items()}, cells, 1)
        hi = _of_cell({k: x for k, (_, x) in span.items()}, cells, 0)  # cells that are done hold no key
        sums: dict[int, list[tuple[int, int]]] = {k: [] for k in span}
        for r in (rows.where(F.col("key").between(lo, hi))
                  .groupBy("cell", F.floor((F.col("key") - lo) / _of_cell(width, cells, 1)).alias("bin"))
                  .agg(F.sum("size").alias("n")).collect()):
            sums.setdefault(r["cell"], []).append((r["bin"], r["n"]))
        for k in list(span):
            below = 0
            for b, n in sorted(sums[k]):
                if below + n >= goal[k]:
                    break
                below += n
            first = span[k][0] + b * width[k]
            if width[k] == 1 or n <= ends[k]["n"] / 4096:
                # the bin goes to the side that brings the lower part closer to its share
                out[k] = first + width[k] if below + n - goal[k] < goal[k] - below else first
                del span[k]
            else:
                goal[k] -= below
                span[k] = (first, min(first + width[k] - 1, span[k][1]))
    return out


def leaves(points: DataFrame, dimensions: int, shards: int) -> DataFrame:
    """The points with their shard: splits, level by level, until each leaf stands for one shard."""
    points = points.withColumn("cell", F.lit(0))
    stands = {0: (0, shards)}  # cell -> its first shard and how many it stands for
    while any(n > 1 for _, n in stands.values()):
        cells = max(stands) + 1
        spread = points.groupBy("cell").agg(*[(F.max(f"c{d}") - F.min(f"c{d}")).alias(f"s{d}") for d in range(dimensions)])
        widest = {r["cell"]: max(range(dimensions), key=lambda d, r=r: r[f"s{d}"]) for r in spread.collect()}
        share = {k: (stands[k][1] // 2) / stands[k][1] for k in widest if stands[k][1] > 1}
        key = _key(widest, cells, dimensions)
        cuts = _cuts(points.select("cell", key.alias("key"), "size"), cells, share)
        above = (key >= _of_cell(cuts, cells, (1 << 63) - 1)).cast("int")
        points = points.withColumn("cell", F.col("cell") * 2 + above)
        stands = {2 * k + side: part for k, (first, n) in stands.items()
                  for side, part in enumerate([(first, n // 2), (first + n // 2, n - n // 2)] if n > 1 else [(first, 1)])}
    return points.withColumn("shard", _of_cell({k: first for k, (first, _) in stands.items()}, max(stands) + 1).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    points = _points(docs, dimensions, shards)
    placed = stage(leaves(points, len(dimensions), shards).select("row", "doc_id", "size", "crc", "shard"), "shard-placed")
    chunks = max(1, -(-placed.count() // (shards * CHUNK_ROWS)))
    rows = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "row"))
    return (rows.withColumn("within", within).join(firsts, ["shard", "chunk"])
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
