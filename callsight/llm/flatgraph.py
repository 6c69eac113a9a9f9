"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

Vectors are assigned to their ``HOMES`` nearest centroids, so shards overlap; a cluster of more than ``SHARD``
vectors is dealt over several shards. Each shard builds a flat graph: near vectors as candidates, pruned so that
a neighbour is dropped where an already chosen one is closer to it by a factor, reverse edges, and every vector
reachable from the shard's medoid. The adjacency lists that a vector has in its shards are united.

Every vector searches its shards: a greedy walk from the medoid (and from the vector itself), then an expansion
through all vectors in reach until no new one is within it. Links lead out of a shard: where a linked vector has
another shard, the search goes on there, from that vector, round by round until none is left. What is found is
verified in double precision. A pair that meets in several shards counts in the first. Pairs never leave a
task: it gives counts and a spanning forest of its links, whose components are found by star contraction.
A bounded set of vectors is compared with all others to audit the recall; below ``RECALL`` the graph is built again
with twice as many homes.

Equal vectors are one vector with a weight. Defined cases: vectors that are null, empty, zero or hold null or
non-finite entries, and rows without an id, link with nothing (no component without an id); vectors of different
lengths are not compared; rows of one id with different vectors are rows of their own; other columns are ignored.
Links among m vectors that are all alike cost m * m comparisons, in tasks of at most ``SHARD`` by ``SHARD``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import stage

LEAST, REACH = 0.9, 0.8
HOMES, SHARD, AIM = 3, 4096, 2048
#: vectors that centroids are fitted on (about), by number and by bytes; vectors of the audit (about)
SAMPLE, SAMPLE_BYTES, AUDIT, RECALL = 16_384, 64 << 20, 1024, 0.9
#: candidates, neighbours and slack of the pruning; width of the walk
NEAR, FAR, DEGREE, SLACK, BEAM = 64, 8, 24, 1.2, 16
_ROWS = 1024
_CODE = 32  # a visit: the round, then the cluster in the lower bits


def unit_rows(batches):
    """(vec_id, digest, size, unit): the vector scaled to length one, in doubles; nulls for what links with nothing."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        at = np.concatenate([[0], np.cumsum(sizes)])
        digests, units = [], []
        for k, known in enumerate(ids.is_valid().to_pylist()):
            v = flat[at[k]:at[k + 1]]
            largest = np.abs(v).max(initial=0.0)
            if not known or not np.isfinite(v).all() or largest == 0.0:
                digests.append(None)
                units.append(None)
                continue
            digests.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
            v = v / largest
            units.append((v / np.sqrt(v @ v)).tobytes())
        yield pa.record_batch([ids.cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(units, pa.binary())],
                              ["vec_id", "digest", "size", "unit"])


def matrix(column) -> np.ndarray:
    """The rows of a column of equally long vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by spherical k-means; a centroid without vectors stays where it was."""
    found = sample[:k].copy()
    for _ in range(rounds):
        of = np.concatenate([(sample[a:a + 4096] @ found.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        size = np.linalg.norm(sums, axis=1)
        found[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return found


def _distances(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * similarity, 0))


def _pruned(x: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Robust pruning for a block: of the candidates ``near`` of each vector ``at``, closest first, those that no
    chosen one is closer to by ``slack``; at most ``degree`` of them, filled up with -1."""
    vectors = x[near]
    own = _distances(np.einsum("bcd,bd->bc", vectors, x[at]))
    between = _distances(vectors @ vectors.transpose(0, 2, 1))
    alive, n = near != at[:, None], np.zeros(len(at), np.int64)
    out = np.full((len(at), degree), -1, np.int64)
    for k in range(near.shape[1]):
        chosen = np.flatnonzero(alive[:, k] & (n < degree))
        if len(chosen):
            out[chosen, n[chosen]] = near[chosen, k]
            n[chosen] += 1
            alive[chosen] &= slack * between[chosen, k] > own[chosen]
    return out


def build(x: np.ndarray, degree: int = DEGREE, slack: float = SLACK, seed: int = 11) -> tuple[list[np.ndarray], int]:
    """Neighbours of each vector of a shard, and its medoid. x: unit rows, float32."""
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    if n == 1:
        return [np.zeros(0, np.int64)], medoid
    rng = np.random.Generator(np.random.PCG64(seed))
    near_n = min(NEAR, n - 1)
    out = np.empty((n, degree), np.int64)
    for a in range(0, n, 256):
        at = np.arange(a, min(n, a + 256))
        s = x[at] @ x.T
        s[np.arange(len(at)), at] = -2
        near = np.argpartition(-s, near_n - 1, axis=1)[:, :near_n]
        near = np.concatenate([near, rng.integers(0, n, (len(at), min(FAR, n)))], 1)
        rank = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        out[at] = _pruned(x, at, np.take_along_axis(near, rank, 1), degree, slack)
    source, place = np.nonzero(out >= 0)
    target = out[source, place]
    edges = np.unique(np.concatenate([source * n + target, target * n + source]))
    edges = edges[edges // n != edges % n]
    lists = np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))
    for v, neighbours in enumerate(lists):
        if len(neighbours) > 2 * degree:  # reverse edges of a hub
            ranked = neighbours[np.argsort(-(x[neighbours] @ x[v]), kind="stable")]
            kept = _pruned(x, np.array([v]), ranked[None, :8 * degree], 2 * degree, slack)[0]
            lists[v] = kept[kept >= 0]
    # every vector can be reached from the medoid: what can't hangs on its nearest that can
    reached = np.zeros(n, bool)
    frontier = np.array([medoid])
    while True:
        while len(frontier):
            reached[frontier] = True
            frontier = np.unique(np.concatenate([lists[v] for v in frontier]))
            frontier = frontier[~reached[frontier]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return lists, medoid
        some, inside = lost[:256], np.flatnonzero(reached)
        for v, best in zip(some, inside[(x[some] @ x[inside].T).argmax(1)]):
            lists[best] = np.append(lists[best], v)
        frontier = some


def _padded(lists, width: int, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(1, width)), fill, np.int64)
    for k, values in enumerate(lists):
        out[k, :len(values)] = values
    return out


def search(x: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, seeds: np.ndarray, reach: float) -> np.ndarray:
    """Which vectors of the graph each query finds in reach: a boolean matrix.

    neighbours: padded with len(x); seeds: entry points of each query, padded likewise."""
    n, b = len(x), len(queries)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    found = np.zeros((b, n + 1), bool)
    expanded = np.zeros((b, n + 1), bool)
    beam = np.full((b, BEAM), n)
    score = np.full((b, BEAM), -3.0, np.float32)

    def look(rows, nodes):
        """Similarity of each query to the vectors that it has not seen yet (else -3)."""
        ordered = np.sort(nodes, axis=1)
        fresh = ~seen[rows[:, None], ordered]
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        r, c = np.nonzero(fresh)
        values = np.full(nodes.shape, -3.0, np.float32)
        got = np.einsum("ij,ij->i", queries[rows[r]], x[ordered[r, c]])
        values[r, c] = got
        seen[rows[r], ordered[r, c]] = True
        close = got >= reach
        found[rows[r[close]], ordered[r[close], c[close]]] = True
        return ordered, values

    def into_beam(rows, nodes, values):
        all_nodes = np.concatenate([beam[rows], nodes], 1)
        all_values = np.concatenate([score[rows], values], 1)
        best = np.argpartition(-all_values, BEAM - 1, axis=1)[:, :BEAM]
        beam[rows] = np.take_along_axis(all_nodes, best, 1)
        score[rows] = np.take_along_axis(all_values, best, 1)

    rows = np.arange(b)
    into_beam(rows, *look(rows, seeds))
    while True:
        open_ = np.where(expanded[np.arange(b)[:, None], beam] | (score <= -3), -3.0, score)
        best = open_.argmax(1)
        rows = np.flatnonzero(open_[np.arange(b), best] > -3)
        if not len(rows):
            break
        nodes = beam[rows, best[rows]]
        expanded[rows, nodes] = True
        into_beam(rows, *look(rows, neighbours[nodes]))
    while True:
        rows, nodes = np.nonzero(found & ~expanded)
        if not len(rows):
            return found[:, :n]
        for a in range(0, len(rows), 4096):
            r, v = rows[a:a + 4096], nodes[a:a + 4096]
            expanded[r, v] = True
            fresh = ~seen[r[:, None], neighbours[v]]
            k, at = np.nonzero(fresh)
            # one query may stand in several rows: what it has not seen is looked at once
            pairs = np.unique(r[k] * (n + 1) + neighbours[v[k], at])
            r, v = pairs // (n + 1), pairs % (n + 1)
            seen[r, v] = True
            close = np.einsum("ij,ij->i", queries[r], x[v]) >= reach
            found[r[close], v[close]] = True


def _verified(found: np.ndarray, queries: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the matrix whose cosine in double precision reaches ``least``."""
    r, c = np.nonzero(found)
    good = np.empty(len(r), bool)
    for a in range(0, len(r), 1 << 15):
        good[a:a + (1 << 15)] = np.einsum("ij,ij->i", queries[r[a:a + (1 << 15)]], x[c[a:a + (1 << 15)]]) >= least
    return r[good], c[good]


def _first_meeting(r, c, visits_q, homes_q, visits_x, homes_x) -> np.ndarray:
    """For each pair the earliest visit by which one of the two came to a home of the other."""
    out = np.empty(len(r), np.int64)
    none = np.int64(1) << 62
    for a in range(0, len(r), 1 << 14):
        p, q = r[a:a + (1 << 14)], c[a:a + (1 << 14)]
        best = np.full(len(p), none)
        for visits, homes in ((visits_q[p], homes_x[q]), (visits_x[q], homes_q[p])):
            meets = ((visits & ((1 << _CODE) - 1))[:, :, None] == homes[:, None, :]).any(2) & (visits >= 0)
            best = np.minimum(best, np.where(meets, visits, none).min(1))
        out[a:a + (1 << 14)] = best
    return out


def _forest(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches by the links (r, c)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[r], label[c])
        np.minimum.at(label, r, least)
        np.minimum.at(label, c, least)
        label = label[label]
        if (label == before).all():
            return label


_MEMBER = "id long, unit binary, n long, homes array<int>, visits array<long>, neighbours array<long>, tops array<int>"
_OUT = "kind string, a long, b long, n long"


def _search_group(round_: int, least: float, reach: float):
    """One shard and the vectors that visit it: counts, links of a spanning forest, and visits to come."""
    def run(key, group):
        cluster, shard, block = (k.as_py() for k in key)
        role = group["role"].to_numpy()
        nodes, guests = (group.filter(pa.array(role == k)).sort_by("id") for k in (0, 1))
        parts: list = []

        def put(kind, a, b, n):
            parts.append(pa.table({"kind": pa.array([kind] * len(a), pa.string()), "a": pa.array(a, pa.int64()),
                                   "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())}))

        put("count", [], [], [])
        itself = shard == block
        visitors = nodes if itself else guests
        if not len(nodes) or not len(visitors):
            return parts[0]
        x64, q64 = matrix(nodes["unit"]), matrix(visitors["unit"])
        x, q = x64.astype(np.float32), q64.astype(np.float32)
        ids, q_ids = nodes["id"].to_numpy(), visitors["id"].to_numpy()
        n = len(ids)

        def local(values):  # places of ids in this shard, without those elsewhere
            values = np.asarray(values, np.int64)
            place = np.minimum(np.searchsorted(ids, values), n - 1)
            return place[ids[place] == values]

        lists = [local(v) for v in nodes["neighbours"].to_pylist()]
        neighbours = _padded(lists, max(map(len, lists)), n)
        tops = [k for k, t in enumerate(nodes["tops"].to_pylist()) if t and cluster in t]
        entry = np.array(tops or [0])
        seeds = np.tile(entry, (len(q_ids), 1))
        if itself:
            seeds = np.concatenate([seeds, np.arange(n)[:, None]], 1)
        elif round_:
            seeds = np.concatenate([seeds, _padded([local([s]) for s in visitors["seed"].to_pylist()], 1, n)], 1)
        found = np.concatenate([search(x, neighbours, q[a:a + _ROWS], seeds[a:a + _ROWS], reach)
                                for a in range(0, len(q), _ROWS)])
        if itself:
            found |= found.T
            np.fill_diagonal(found, False)
        r, c = _verified(found, q64, x64, least)
        del found
        if not len(r):
            return parts[0]

        def lists_of(rows, name):
            values = rows[name].to_pylist()
            return _padded(values, max(map(len, values)), -1)

        homes_x, homes_q = lists_of(nodes, "homes"), lists_of(visitors, "homes")
        visits_x, visits_q = lists_of(nodes, "visits"), lists_of(visitors, "visits")
        here = (round_ << _CODE) + cluster
        first = _first_meeting(r, c, visits_q, homes_q, visits_x, homes_x) == here
        weight_x, weight_q = nodes["n"].to_numpy(), visitors["n"].to_numpy()
        links_q = np.bincount(r[first], weight_x[c[first]], len(q_ids)).astype(np.int64)
        some = np.flatnonzero(links_q)
        put("count", q_ids[some], q_ids[some], links_q[some])
        if not itself:
            links_x = np.bincount(c[first], weight_q[r[first]], n).astype(np.int64)
            some = np.flatnonzero(links_x)
            put("count", ids[some], ids[some], links_x[some])
        everyone = ids if itself else np.concatenate([ids, q_ids])
        label = _forest(len(everyone), r if itself else r + n, c)
        some = np.flatnonzero(label != np.arange(len(label)))
        put("link", everyone[some], everyone[label[some]], np.zeros(len(some), np.int64))
        # a linked vector leads into its other shards, if its partner has not been there
        for who, who_ids, known, other, other_ids, other_homes in (
                (r, q_ids, visits_q, c, ids, homes_x), (c, ids, visits_x, r, q_ids, homes_q))[:1 if itself else 2]:
            been = np.where(known >= 0, known & ((1 << _CODE) - 1), -1)
            leads = []
            for a in range(0, len(who), 1 << 14):
                w, o = who[a:a + (1 << 14)], other[a:a + (1 << 14)]
                to = other_homes[o]
                new = (to >= 0) & ~(to[:, :, None] == been[w][:, None, :]).any(2)
                k, h = np.nonzero(new)
                # one lead a vector and cluster
                _, one = np.unique(w[k] * (1 << 32) + to[k, h], return_index=True)
                leads.append(np.stack([w[k[one]], to[k[one], h[one]], other_ids[o[k[one]]]]))
            w, to, seed = np.concatenate(leads, 1)
            _, one = np.unique(w * (1 << 32) + to, return_index=True)
            put("visit", who_ids[w[one]], to[one], seed[one])
        return pa.concat_tables(parts)

    return run


def _shards(k: int, counts: dict) -> list[int]:
    return [max(1, -(-counts.get(c, 0) // SHARD)) for c in range(k)]


def _counts(rows: DataFrame) -> dict:
    """Rows of each cluster; clusters are a bounded number."""
    return {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}


def _assigned(vectors: DataFrame, n: int, size: int, homes: int) -> tuple[DataFrame, int]:
    """The vectors with their nearest centroids, and the number of centroids."""
    limit = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * size)))
    some = vectors.select("digest", "unit")
    if n > limit:  # by the digest, so a vector is in the sample or not whatever the partitions
        share = int((1 << 62) * (limit / n))
        some = some.where(F.shiftright(F.xxhash64("digest"), 1).between(0, share))
    sample = matrix(some.orderBy("digest").select("unit").toArrow()["unit"]) if n else np.zeros((0, size))
    k = max(1, min(-(-n * homes // AIM), len(sample) // 8))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids(sample[:2 * limit], k) if len(sample) else np.ones((1, size)))
    top = min(homes, k)

    def run(batches):
        for batch in batches:
            s = matrix(batch.column(1)) @ shared.value.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :top].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top * len(near) + 1, top, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in range(3)), lists], ["id", "unit", "n", "homes"])

    return stage(vectors.select("id", "unit", "n").mapInArrow(run, "id long, unit binary, n long, homes array<int>"), "graph-homes"), k


def _built(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """The vectors with the union of their adjacency lists, and the clusters whose shards they are medoids of."""
    def run(key, group):
        group = group.sort_by("id")
        ids = group["id"].to_numpy()
        lists, medoid = build(matrix(group["unit"]).astype(np.float32))
        tops = [[key[0].as_py()] if k == medoid else [] for k in range(len(ids))]
        return pa.table({"id": pa.array(ids), "some": pa.array([ids[v] for v in lists], pa.list_(pa.int64())),
                         "top": pa.array(tops, pa.list_(pa.int32()))})

    of = _in_shards(assigned.select("id", "unit", "homes"), clusters)
    lists = of.select("c", "sub", "id", "unit").groupBy("c", "sub").applyInArrow(run, "id long, some array<long>, top array<int>")
    union = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("neighbours"),
                                    F.flatten(F.collect_list("top")).alias("tops"))
    return stage(assigned.join(union, "id").select(
        "id", "unit", "n", "homes", F.col("homes").cast("array<long>").alias("visits"), "neighbours", "tops"), "graph")


def _in_shards(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row for each home c, with the shard sub that the vector has there."""
    return (vectors.select("*", F.explode("homes").alias("c")).join(F.broadcast(clusters), "c")
            .withColumn("sub", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")))


def _linked(vectors: DataFrame, n: int, size: int, homes: int, least: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) counts of links, and (u, v) links that connect what is linked."""
    spark = vectors.sparkSession
    assigned, k = _assigned(vectors, n, size, homes)
    shards = _shards(k, _counts(assigned.select(F.explode("homes").alias("c"))))
    clusters = spark.createDataFrame(list(enumerate(shards)), "c int, shards int")
    graph = _built(assigned, clusters)
    fields = [c.split()[0] for c in _MEMBER.split(", ")]
    plain = [*fields, "c", "s", "b"]

    members = _in_shards(graph, clusters)
    role, no_seed = F.lit(0).alias("role"), F.lit(None).cast("long").alias("seed")
    rows = (members.withColumn("s", F.col("sub")).withColumn("b", F.explode(F.expr("sequence(sub, shards - 1)"))).select(*plain, role, no_seed)
            .union(members.where("sub > 0").withColumn("b", F.col("sub")).withColumn("s", F.explode(F.expr("sequence(0, sub - 1)")))
                   .select(*plain, F.lit(1).alias("role"), no_seed)))
    counts, links, round_, state = [], [], 0, graph
    while True:
        got = stage(rows.groupBy("c", "s", "b").applyInArrow(_search_group(round_, least, reach), _OUT), "graph-found")
        counts.append(got.where("kind = 'count'").select("a", "n"))
        links.append(got.where("kind = 'link'").select(F.col("a").alias("u"), F.col("b").alias("v")))
        visits = stage(got.where("kind = 'visit'").groupBy("a", "b").agg(F.min("n").alias("seed"))
                       .select(F.col("a").alias("id"), F.col("b").cast("int").alias("c"), "seed"), "graph-visits")
        guests = _counts(visits)
        if not guests:
            break
        round_ += 1
        came = visits.groupBy("id").agg(F.collect_list(F.col("c").cast("long") + F.lit(round_ << _CODE)).alias("came"))
        state = stage(state.join(came, "id", "left").withColumn("visits", F.concat("visits", F.coalesce("came", F.slice("visits", 1, 0))))
                      .select(fields), "graph-state")
        rooms = spark.createDataFrame([(c, shards[c], -(-guests[c] // SHARD)) for c in sorted(guests)], "c int, shards int, blocks int")
        hosts = (_in_shards(state, rooms.drop("blocks")).join(F.broadcast(rooms.select("c", "blocks")), "c").withColumn("s", F.col("sub"))
                 .withColumn("b", F.explode(F.expr("sequence(shards, shards + blocks - 1)"))))
        coming = (visits.join(state, "id").join(F.broadcast(rooms), "c")
                  .withColumn("b", (F.col("shards") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
                  .withColumn("s", F.explode(F.expr("sequence(0, shards - 1)"))))
        rows = hosts.select(*plain, role, no_seed).union(coming.select(*plain, F.lit(1).alias("role"), "seed"))
    union = counts[0]
    for more in counts[1:]:
        union = union.union(more)
    joined = links[0]
    for more in links[1:]:
        joined = joined.union(more)
    return union.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links")), joined


def audit(vectors: DataFrame, links: DataFrame, n: int, least: float) -> float:
    """Share of the links of about ``AUDIT`` vectors, compared with all others, that were found."""
    share = F.shiftright(F.xxhash64("digest", F.lit("audit")), 1).between(0, int((1 << 62) * min(1.0, AUDIT / max(n, 1))))
    some = vectors.where(share).select("id", "unit").orderBy("id").toArrow()
    if not len(some):
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast((some["id"].to_numpy(), matrix(some["unit"])))

    def run(batches):
        ids, units = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            x, n = matrix(batch.column(1)), batch.column(2).to_numpy()
            for a in range(0, len(x), 4096):
                near = units @ x[a:a + 4096].T >= least
                near &= ids[:, None] != batch.column(0).to_numpy()[None, a:a + 4096]
                total += near @ n[a:a + 4096]
        yield pa.record_batch([pa.array(ids), pa.array(total)], ["id", "linked"])

    true = vectors.select("id", "unit", "n").mapInArrow(run, "id long, linked long").where("linked > 0").groupBy("id").agg(F.sum("linked").alias("linked"))
    sums = true.join(links, "id", "left").agg(F.sum("linked").alias("linked"), F.sum("links").alias("found")).first()
    return 1.0 if not sums["linked"] else (sums["found"] or 0) / sums["linked"]


def near_vectors(rows: DataFrame, least: float = LEAST, reach: float = REACH, homes: int = HOMES) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall of every row of rows (vec_id, embedding)."""
    rows = stage(rows.select("vec_id", "embedding").mapInArrow(unit_rows, "vec_id long, digest binary, size long, unit binary"), "graph-units")
    classes = stage(rows.where("digest is not null").groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("size").alias("size"), F.first("unit").alias("unit"))
        .withColumn("id", F.monotonically_increasing_id()), "graph-classes")
    counts, links, recalls = [], [], [1.0]
    for size, n in sorted((r["size"], r["count"]) for r in classes.groupBy("size").count().collect()):
        vectors, now = classes.where(F.col("size") == size), homes
        while True:
            count, link = _linked(vectors, n, size, now, least, reach)
            count = stage(count, "graph-counts")
            recall = audit(vectors, count, n, least)
            if recall >= RECALL or now * AIM >= SAMPLE * AIM:
                break
            now *= 2
        counts.append(count)
        links.append(link)
        recalls.append(recall)
    empty = classes.limit(0)
    counted, linked = empty.select("id", F.col("n").alias("links")), empty.select(F.col("id").alias("u"), F.col("id").alias("v"))
    for count, link in zip(counts, links):
        counted, linked = counted.union(count), linked.union(link)
    least_of = classes.select("id", "least")
    members = stage(components(linked), "graph-members").join(least_of, "id")
    smallest = members.groupBy("component_id").agg(F.min("least").alias("first"))
    named = members.select("id", "component_id").join(smallest, "component_id").select("id", "first")
    known = (classes.select("digest", "id", "n", "least").join(counted, "id", "left").join(named, "id", "left")
             .select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("first", "least").alias("component_id")))
    out = ["vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
           F.lit(float(min(recalls))).alias("audited_recall")]
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.where("digest is not null").select("vec_id", "digest").join(known, "digest").select(out).union(alone.select(out))
