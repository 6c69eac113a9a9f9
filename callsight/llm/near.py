"""Near duplicates of five-word shingle sets by an LSH forest.

Every set gets one min-hash signature per tree, which orders the sets in that tree; sets that
share a prefix stand together. A region is the run of sets that share ``levels[0]`` values.
Where it holds more than ``crowd`` sets, candidates come from deeper prefixes instead, level by
level, so depth adapts to each region. Candidates are the pairs of the longest common prefix: the
members of each run that is small enough, and, in a crowded run at any level, each member with
the run's leader, which is found by going down the run's most crowded branch. All candidates are
confirmed on the full sets; links become components by star contraction.

What crowded runs leave uncompared is found exactly: the members of runs that are crowded at the
first level are joined on the rarest shingles of their sets (prefix and position filter). Only pairs
of different components are made, so a large group of near copies makes none inside itself.

A row is known by the 64-bit hash of its doc_id and text, so rows of one doc_id with different texts stand
apart. Equal sets are one class: only one of its rows enters the forest. A pair is lost only if it
shares no first-level run in any tree; for a pair at similarity s that is (1 - s ** 4) ** trees.
There are 16 trees, or as many more as keep it under ``MISSED`` at ``percent`` (22 at 80).

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are
their own component; a text of fewer than five words has its word sequence as its one shingle;
rows with a null doc_id are reported with a null component and not linked (``deduplicate`` keeps
them). A component is named by its smallest doc_id; ``deduplicate`` keeps one of its rows: that of this doc_id, and of
several rows of that id, one.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .probe import Probe, among, without
from .staging import stage
from .words import mix, shingles, slices, words_of

TREES, LEVELS, CROWD = 16, (4, 6, 8, 10, 12), 24
#: chance at most that a pair at the asked similarity shares no first-level run
MISSED = 1e-5
#: counters that order the shingles by how many sets hold them; two that share one only change the order
COUNTERS = 1 << 20


def trees_for(percent: int, level: int = LEVELS[0]) -> int:
    """Trees that keep the chance of a missed pair under ``MISSED``, at least ``TREES``."""
    shared = (percent / 100) ** level
    return TREES if shared >= 1 else max(TREES, math.ceil(math.log(MISSED) / math.log1p(-shared)))


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8))
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))


def shingle_sets(column: pa.Array, size: int = 5):
    """For each text its distinct shingle hashes, ascending."""
    for _, piece in slices(column):
        words, at = words_of(piece)
        all_, where = shingles(words, at, size)
        for a, b in zip(where[:-1], where[1:]):
            yield np.unique(all_[a:b])


def _signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(out, (short[k:k + 512][None, :] * a[:, None] + b[:, None]).min(1), out=out)
    return out


def _sketch(size: int, trees: int, depth: int):
    a, b = _hash_family(trees * depth)

    def run(batches):
        import hashlib

        for batch in batches:
            counts, digests, signatures = [], [], []
            for values in shingle_sets(batch.column(2), size):
                counts.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                signatures.append(_signature(values, a, b).tobytes() if len(values) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                                   pa.array(signatures, pa.binary())], ["id", "doc_id", "n_shingles", "digest", "signature"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task without it

    return run


def _prefixes(trees: int, levels: tuple[int, ...]):
    depth = levels[-1]
    names = [f"k{d}" for d in levels]

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, trees, depth)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), trees)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64)), sig.shape[:2]).copy()
                out = []
                for d in range(depth):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d])
                    if d + 1 in levels:
                        out.append(pa.array(key.ravel().view(np.int64)))
            yield pa.record_batch([pa.array(ids, pa.int64()), *out], ["id", *names])

    return run, "id long, " + ", ".join(f"{n} long" for n in names)


def prefixes(signatures: DataFrame, copies: DataFrame, trees: int = TREES, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """id and a prefix key for every level, a row for each tree, without the ids listed as copies.

    signatures: id, signature. Signatures that the list can't concern aren't shuffled; the filter
    and the keys share one Python worker."""
    run, kind = _prefixes(trees, levels)
    probe = Probe(copies)
    clear = probe.keep(False)
    listed = copies.toDF("_listed").distinct().hint("merge")
    doubtful = signatures.mapInArrow(probe.keep(True), signatures.schema)
    doubtful = doubtful.join(listed, doubtful["id"] == listed["_listed"], "left_anti")
    return signatures.mapInArrow(lambda batches: run(clear(batches)), kind).union(doubtful.mapInArrow(run, kind))


def candidates(rows: DataFrame, levels: tuple[int, ...] = LEVELS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of ids to compare, and the ids in runs that are crowded at the first level.

    rows: id and its prefix keys in each tree."""
    names = [f"k{d}" for d in levels]
    shared = rows.groupBy(names[0]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = stage(rows.join(shared, names[0]), "near-prefixes")
    # runs from the deepest level up: size, and the leader of the most crowded branch
    runs = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(f"n_{names[-1]}"), F.min("id").alias(f"l_{names[-1]}"))
    tables = {names[-1]: runs}
    for up, name in zip(names[-2::-1], names[:0:-1]):
        n, leader = f"n_{name}", f"l_{name}"
        runs = runs.groupBy(*names[:names.index(up) + 1]).agg(
            F.sum(n).alias(f"n_{up}"), F.max_by(leader, F.struct(n, -F.col(leader))).alias(f"l_{up}"))
        tables[up] = runs
    # every deepest run knows the size and leader of the runs around it
    around = tables[names[-1]]
    for name in names[:-1]:
        around = around.join(tables[name].select(name, f"n_{name}", f"l_{name}"), name)
    around = stage(around, "near-runs")
    region = F.coalesce(*[F.when(F.col(f"n_{x}") <= crowd, F.col(x)) for x in names])
    full = around.where(F.col(f"n_{names[0]}") > crowd).select(names[0]).distinct()
    crowded = rows.join(full, names[0], "left_semi").select("id").distinct()
    rows = rows.join(around.withColumn("region", region), names)
    close = (rows.where("region is not null").groupBy("region").agg(F.array_sort(F.collect_set("id")).alias("ids"))
             .where("size(ids) > 1").select(F.posexplode("ids").alias("i", "a"), "ids")
             .select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b")))
    # below its region's level no run is crowded, so those leaders add nothing
    led = reduce(DataFrame.union, [
        rows.where(F.col(f"n_{x}") > crowd).select(F.least("id", f"l_{x}").alias("a"), F.greatest("id", f"l_{x}").alias("b"))
        for x in names])
    return close.union(led).where("a != b").distinct(), crowded


def _sets(size: int):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), size)],
                                                             pa.binary())], ["id", "shingles"])
        pa.default_memory_pool().release_unused()

    return run


def _count(batches):
    """(slot, n): how many sets hold a shingle of each counter."""
    out = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            values = np.frombuffer(b"".join(batch.column(0)[k:k + 256].to_pylist()), np.uint64)
            out += np.bincount((values & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    some = np.flatnonzero(out)
    yield pa.record_batch([pa.array(some), pa.array(out[some])], ["slot", "n"])


def _rarest(percent: int, shared):
    """The rarest shingles of each set, as many as a set of the asked similarity can't all miss, with their places."""
    def run(batches):
        counts = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids, groups, sets = (batch.column(c)[k:k + 256] for c in range(3))
                first, sizes = [], []
                for value in sets:
                    values = np.frombuffer(value.as_buffer(), np.uint64)
                    order = np.lexsort((values, counts[(values & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    first.append(values[order[:len(values) - -(-len(values) * percent // 100) + 1]])
                    sizes.append(len(values))
                lengths = np.array([len(f) for f in first], np.int64)
                spread = [np.repeat(x, lengths) for x in (ids.to_numpy(zero_copy_only=False), groups.to_numpy(zero_copy_only=False), sizes)]
                places = np.concatenate([np.arange(n) for n in lengths])
                yield pa.record_batch([pa.array(np.concatenate(first).view(np.int64)), *[pa.array(x, pa.int64()) for x in (*spread, places)]],
                                      ["shingle", "id", "component", "n", "place"])

    return run


def crowd_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of different components, with every pair of the asked similarity among them.

    sets: id, component, shingles, a written table. In one order of all shingles, rarest first, two sets
    of n <= m shingles that share ``need`` = percent * (n + m) / (100 + percent) have their first shared
    one in front of the last ``need`` of both; the smaller set needs only the places that it could have
    with an equally large one. Of each shingle's largest component only the pairs with others are made."""
    rows = sets.select("shingles").mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    places = stage(sets.mapInArrow(_rarest(percent, shared), "shingle long, id long, component long, n long, place long"), "near-places")
    mixed = (places.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle")
             .agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("components"))
             .where("components > 1").select("shingle", "main"))
    places = stage(places.join(mixed, "shingle").withColumn("other", F.col("component") != F.col("main")).drop("main"), "near-mixed")
    x = places.where(f"(n - place) * {100 + percent} >= 2 * {percent} * n").alias("x")
    y = places.alias("y")
    fits = F.expr(f"""x.shingle = y.shingle and x.component != y.component and (x.n < y.n or x.n = y.n and x.id < y.id)
        and x.n * 100 >= y.n * {percent} and least(x.n - x.place, y.n - y.place) * {100 + percent} >= {percent} * (x.n + y.n)""")
    pairs = [x.where(a).join(y.where(b), fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
             for a, b in (("true", "y.other"), ("x.other", "not y.other"))]
    return pairs[0].union(pairs[1]).distinct()


def _alike(percent: int):
    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x), bool)
        for k, (p, q) in enumerate(zip(x, y)):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[k] = 100 * both >= percent * (len(p) + len(q) - both)
        return pa.array(out)

    return alike


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, size: int = 5) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity. docs: id, text."""
    wanted = stage(pairs.select("a").union(pairs.select("b")).distinct(), "near-wanted")
    kept = stage(among(docs, "id", wanted).mapInArrow(_sets(size), "id long, shingles binary"), "near-sets")
    # few shingles can't reach the share of many: pairs of too unequal size leave before the sets are moved
    sizes = kept.select("id", F.octet_length("shingles").alias("n"))
    fair = (pairs.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
            .where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b"))
    return (fair.join(kept.toDF("a", "x"), "a").join(kept.toDF("b", "y"), "b")
            .where(_alike(percent)("x", "y")).select("a", "b"))


def row_id(*columns: str):
    """What a row is known by: the hash of its id and text."""
    return F.xxhash64(*(columns or ("doc_id", "text")))


def marked(docs: DataFrame, percent: int = 85, size: int = 5, trees: int | None = None,
           levels: tuple[int, ...] = LEVELS, crowd: int = CROWD) -> DataFrame:
    """id (``row_id``), doc_id, n_shingles, component_id and first (whether the row stands for its component) of every row;
    linked means similarity of ``percent`` or more."""
    trees = trees or trees_for(percent, levels[0])
    texts = docs.select(row_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stage(texts.mapInArrow(_sketch(size, trees, levels[-1]),
                                      "id long, doc_id long, n_shingles long, digest binary, signature binary"), "near-sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    # the row that stands for a class is that of the smallest doc_id
    classes = stage(full.groupBy("digest").agg(F.min(F.struct("doc_id", "id")).alias("best"), F.count(F.lit(1)).alias("n")).select(
        "digest", "best", F.col("best.id").alias("id"), "n"), "near-classes")
    # other rows of a set stay out of the forest; few rows are on that list, so few are shuffled
    copies = full.select("digest", F.col("id").alias("row")).join(classes.where("n > 1"), "digest").where("row != id").select("row")
    rows = prefixes(full.select("id", "signature"), stage(copies, "near-copies"), trees, levels)
    pairs, crowded = candidates(rows, levels, crowd)
    keyed = texts.where("doc_id is not null").select("id", "text")
    reached = components(confirmed(stage(pairs, "near-pairs"), keyed, percent, size).toDF("u", "v"))
    crowded = stage(crowded, "near-crowded")
    if not crowded.isEmpty():
        reached = stage(reached, "near-reached")
        sets = among(keyed, "id", crowded).mapInArrow(_sets(size), "id long, shingles binary").join(reached, "id", "left")
        sets = stage(sets.select("id", F.coalesce("component_id", "id").alias("component"), "shingles").dropDuplicates(["id"]), "near-crowd-sets")
        pairs = stage(crowd_pairs(sets, percent), "near-crowd-pairs")
        if not pairs.isEmpty():
            reached = components(reached.union(confirmed(pairs, keyed, percent, size)).toDF("u", "v"))
    reached = stage(reached, "near-reached")
    heads = reached.join(classes.select("id", "best"), "id").groupBy("component_id").agg(F.min("best").alias("head"))
    named = reached.join(heads, "component_id").select("id", "head")
    members = classes.join(named, "id", "left").select("digest", F.coalesce("head", "best").alias("head"))
    joined = sketches.select("id", "doc_id", "n_shingles", "digest").join(members, "digest", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return joined.select("id", "doc_id", "n_shingles", F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         (~linked | (F.col("id") == F.col("head.id"))).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, trees: int | None = None,
                    levels: tuple[int, ...] = LEVELS, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; linked means similarity of ``percent`` or more."""
    return marked(docs, percent, size, trees, levels, crowd).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each near-duplicate group (of the smallest doc_id), with all its columns."""
    marks = stage(marked(docs, percent, size).select("id", "doc_id", "n_shingles", "first"), "near-marks")
    keyed = docs.select(row_id().alias("_near_row"), "*")
    kept = without(keyed, "_near_row", stage(marks.where("not first").select("id"), "near-dropped"))
    # rows equal in id and text are one
    repeated = stage(marks.where("first and n_shingles > 0 and doc_id is not null").groupBy("id").count().where("count > 1").select("id"), "near-repeated")
    if not repeated.isEmpty():
        kept = without(kept, "_near_row", repeated).union(among(kept, "_near_row", repeated).dropDuplicates(["_near_row"]))
    return kept.drop("_near_row")
