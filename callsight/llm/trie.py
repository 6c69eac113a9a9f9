"""Prefix trie of conversations, from the least common prefixes of their sorted order.

A conversation is a sequence of turns (role, text); every distinct sequence of its first d turns is a
node of depth d, and the conversations that start with it are its members. Sorted by their turns,
a node's members stand together, so a node is an interval. Each turn counts as a 16-byte digest, a
conversation as the bytes of its digests one after the other (``path``), whose byte order is the order
of sequences; Spark sorts paths over range partitions, ties by conv_id.

Blocks of the sorted order hold a sparse table of range minima over the common prefix of each
conversation with the one before. Every candidate prefix (a conversation and a depth that the one before
does not share) finds its left and its right extent by a binary search of its own; no stack is kept.
Members, children, leaves and saved bytes of a node are sums over its interval, and its smallest member is a
range minimum. What touches a block's border and goes on beyond it is a piece; pieces of one node are added up
by the digest of its prefix, so a prefix of all conversations is one row a block.

Defined cases: a null role or text is empty; turns are ordered by ``turn``, null first, ties by their digest;
repeated turns stay; rows with a null conv_id are no conversation; a conversation without turns is a
member of the root only; an empty table has no node, not even the root; other columns are ignored.
The digests of one conversation (16 bytes a turn), not its texts, must fit a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: conversations and turns of a block at most (a longer conversation is a block of its own)
BLOCK, BLOCK_TURNS = 4096, 1 << 16
WIDTH = 16
_BLOCKS = ("part int, block int, first boolean, last boolean, ids array<long>, lengths array<int>, paths binary, "
           "sizes array<long>, before binary, after binary")
_COUNTS = "n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"
_NODES = f"depth int, {_COUNTS}, parent_conv_id long, parent binary, ends_sha256 string, key binary, ends binary, part int, block int"
_NAMES = [c.split()[0] for c in _NODES.split(", ")]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: an array of (digest, size), size in UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length keeps (role, text) apart from any other split of the same characters
    digest = F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), 1, 2 * WIDTH)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                    digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return (turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")))


def with_shared_heads(convs: DataFrame, base: Column, heads: Column, longest: int) -> DataFrame:
    """Conversations rebuilt: the first ``heads`` turns of conversation ``base``, then the own turns after as many.

    heads is at most ``longest``; a base that is missing gives no turns."""
    first = convs.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, longest).alias("_head"))
    own = convs.withColumn("_base_id", base).withColumn("_n", heads.cast("int"))
    joined = own.join(first, F.col("_base_id") == F.col("_base"), "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.coalesce(F.expr("slice(_head, 1, _n)"), none),
                                             F.expr("slice(turns, _n + 1, greatest(size(turns) - _n, 0))")).alias("turns"))


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    low, high = 0, n  # shared up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


class RangeMinimum:
    """Sparse table over an array: row k holds the minimum of every 2**k neighbours."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            last, step = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def minimum(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of each closed range."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.rows[k][first[of]], self.rows[k][last[of] - (1 << k) + 1])
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l with every value of (l, at] not under ``least``."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            can = at - (1 << k) >= 0
            go = can.copy()
            go[can] = self.rows[k][at[can] - (1 << k) + 1] >= least[can]
            at[go] -= 1 << k
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r with every value of (at, r] not under ``least``."""
        at, n = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            can = at + (1 << k) < n
            go = can.copy()
            go[can] = self.rows[k][at[can] + 1] >= least[can]
            at[go] += 1 << k
        return at


def _cut(batches):
    """Blocks of a sorted partition. A block knows the paths around it, but for those beyond the partition."""
    part = TaskContext.get().partitionId()
    block, before, turns, number = [], None, 0, 0

    def made(after):
        ids, paths, sizes = zip(*block)
        row = {"part": [part], "block": [number], "first": [before is None], "last": [after is None], "ids": [list(ids)],
               "lengths": [[len(p) // WIDTH for p in paths]], "paths": [b"".join(paths)],
               "sizes": [np.concatenate([np.asarray(s, np.int64) for s in sizes])], "before": [before], "after": [after]}
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(),
                 pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

    for batch in batches:
        sizes, at = batch.column(2), batch.column(2).offsets.to_numpy()
        flat = sizes.values.to_numpy(zero_copy_only=False)
        for k, (i, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            n = len(path) // WIDTH
            if block and (len(block) >= BLOCK or turns + n > BLOCK_TURNS):
                yield made(path)
                before, block, turns, number = block[-1][1], [], 0, number + 1
            block.append((i, path, flat[at[k]:at[k + 1]]))
            turns += n
    if block:
        yield made(None)


def _prefix_keys(path: bytes) -> list[bytes]:
    """Digest of each prefix of a path, from the empty one on."""
    state = hashlib.blake2b(digest_size=WIDTH)
    out = [state.digest()]
    for k in range(0, len(path), WIDTH):
        state.update(path[k:k + WIDTH])
        out.append(state.copy().digest())
    return out


def block_nodes(ids, lengths, paths: bytes, sizes, before: bytes | None, after: bytes | None):
    """Columns of the nodes and pieces of a block. before, after: the paths around it (null at the ends)."""
    n = len(ids)
    ends_at = np.cumsum(lengths)
    starts = ends_at - lengths
    path = [paths[a * WIDTH:b * WIDTH] for a, b in zip(starts.tolist(), ends_at.tolist())]
    shared = np.array([-1, *map(common_prefix, path, path[1:])], np.int64)  # with the one before, inside of the block
    outer = -1 if before is None else common_prefix(before, path[0])
    following = -1 if after is None else common_prefix(path[-1], after)
    least, smallest = RangeMinimum(shared), RangeMinimum(ids)

    fresh = lengths - shared  # a candidate for every depth that the one before does not share
    offsets = np.concatenate([[0], np.cumsum(fresh)])
    i = np.repeat(np.arange(n), fresh)
    d = np.arange(offsets[-1]) - offsets[i] + shared[i] + 1
    l, r = least.left(i, d), least.right(i, d)

    real = shared.copy()  # shared with the one before, across the border too
    real[0] = outer
    next_real = np.append(real[1:], following)
    total = np.concatenate([[0], np.cumsum(sizes)])
    upto = lambda j, depth: total[starts[j] + np.maximum(depth, 0)] - total[starts[j]]  # noqa: E731  bytes of its first turns
    leaf = np.concatenate([[0], np.cumsum(next_real < lengths)])
    held = np.concatenate([[0], np.cumsum(upto(np.arange(n), shared))])
    above = upto(l, d - 1)
    saved = held[r + 1] - held[l + 1] - (r - l) * above
    saved += np.where(l == 0, upto(np.zeros_like(l), np.maximum(outer, d - 1)) - above, 0)

    children = ((lengths[i] > d) & (real[i] <= d)).astype(np.int64)
    # every other conversation with turns of its own begins a child of the node at the shared depth
    j = np.flatnonzero((lengths > shared) & (shared >= 0))
    holder = least.left(j, shared[j])
    np.add.at(children, offsets[holder] + shared[j] - shared[holder] - 1, 1)

    partial = (l == 0) & (d <= outer) | (r == n - 1) & (d <= following)
    up = np.where(d > shared[i] + 1, np.arange(len(d)) - 1, -1)  # the candidate of the same conversation one turn up
    of = np.flatnonzero((up < 0) & (d > 0))
    home = least.left(i[of], d[of] - 1)
    up[of] = offsets[home] + d[of] - 1 - shared[home] - 1
    conv = smallest.minimum(l, r)

    # members that end in a node are equal, and come first in it
    ended = np.flatnonzero(lengths[l] == d)
    equal = (lengths == shared) & (np.append(0, lengths[:-1]) == lengths)  # to the one before
    runs = np.append(np.flatnonzero(~equal), n)
    run = runs[np.searchsorted(runs, l[ended], side="right")]
    texts: list = [None] * len(d)
    for c, a, b in zip(ended.tolist(), l[ended].tolist(), run.tolist()):
        texts[c] = ",".join(map(str, ids[a:b].tolist())).encode()

    first_keys, last_keys = _prefix_keys(path[0]), _prefix_keys(path[-1])  # a piece reaches one of the two

    parents = np.where(up >= 0, up, 0)
    open_parent = (up >= 0) & partial[parents]
    keys: list = [None] * len(d)
    for c in np.flatnonzero(partial).tolist():
        keys[c] = (first_keys if l[c] == 0 else last_keys)[d[c]]
    none = hashlib.sha256(b"").hexdigest()
    shas = [None if p else hashlib.sha256(t).hexdigest() if t is not None else none for p, t in zip(partial.tolist(), texts)]
    known = (up >= 0) & ~open_parent
    return {
        "depth": pa.array(d, pa.int32()), "n_convs": pa.array(r - l + 1, pa.int64()), "conv_id": pa.array(conv, pa.int64()),
        "n_children": pa.array(children), "n_leaves": pa.array(leaf[r + 1] - leaf[l], pa.int64()),
        "saved_tokens": pa.array(saved, pa.int64()), "parent_conv_id": pa.array(conv[parents], pa.int64(), mask=~known),
        "parent": pa.array([keys[u] if o else None for u, o in zip(parents.tolist(), open_parent.tolist())], pa.binary()),
        "ends_sha256": pa.array(shas, pa.string()), "key": pa.array(keys, pa.binary()),
        "ends": pa.array([t if p else None for p, t in zip(partial.tolist(), texts)], pa.binary())}


def _nodes_of_blocks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            columns = block_nodes(np.asarray(row["ids"], np.int64), np.asarray(row["lengths"], np.int64), row["paths"],
                                  np.asarray(row["sizes"], np.int64), row["before"], row["after"])
            n = len(columns["depth"])
            columns |= {"part": pa.array(np.full(n, row["part"], np.int32)), "block": pa.array(np.full(n, row["block"], np.int32))}
            yield pa.RecordBatch.from_pydict(columns).select(_NAMES)


def _ends(batches):
    """(key, ends_sha256) of rows (key, text), a key's rows one after the other in the order of their ids."""
    now, state = None, None
    for batch in batches:
        keys, digests = [], []
        for key, text in zip(*(batch.column(c).to_pylist() for c in range(2))):
            if key != now:
                if now is not None:
                    keys.append(now)
                    digests.append(state.hexdigest())
                now, state = key, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def blocks(convs: DataFrame) -> DataFrame:
    """The sorted order in blocks, each with the paths around it. convs: conv_id (unique), turns."""
    paths = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
                         F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = stage(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_cut, _BLOCKS),
                 "trie-blocks")
    # a partition's borders: one row a partition
    first = F.expr(f"substring(paths, 1, lengths[0] * {WIDTH})")
    last = F.expr(f"substring(paths, octet_length(paths) - {WIDTH} * element_at(lengths, -1) + 1, {WIDTH} * element_at(lengths, -1))")
    borders = rows.where("first or last").groupBy("part").agg(F.max(F.when(F.col("first"), first)).alias("head"),
                                                              F.max(F.when(F.col("last"), last)).alias("tail"))
    in_order = Window.orderBy("part")
    borders = borders.select("part", F.lag("tail").over(in_order).alias("left"), F.lead("head").over(in_order).alias("right"))
    return (rows.join(borders, "part")
            .withColumn("before", F.when(F.col("first"), F.col("left")).otherwise(F.col("before")))
            .withColumn("after", F.when(F.col("last"), F.col("right")).otherwise(F.col("after")))
            .select("part", "block", "ids", "lengths", "paths", "sizes", "before", "after"))


def trie(convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: conv_id (unique) and turns, an array of (digest, size) as ``sequences`` makes it. saved_tokens sums, over
    the node's subtree, the size of each node's last turn for every member but one."""
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = stage(blocks(convs).mapInArrow(_nodes_of_blocks, _NODES), "trie-nodes")
    pieces = nodes.where("key is not null")
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = stage(pieces.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), *summed),
                   "trie-merged")
    ends = (pieces.where("ends is not null").select("key", "part", "block", "ends").repartition("key")
            .sortWithinPartitions("key", "part", "block").select("key", "ends").mapInArrow(_ends, "key binary, ends_sha256 string"))
    heads = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.where("key is null")
    none = hashlib.sha256(b"").hexdigest()
    joined = merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    top = joined.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return (whole.where("parent is null").select(out)
            .union(whole.where("parent is not null").drop("parent_conv_id").join(heads, "parent").select(out))
            .union(joined.where("parent is not null").join(heads, "parent").select(out))
            .union(top.select(out)))
