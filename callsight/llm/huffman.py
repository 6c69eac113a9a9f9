"""Token ids as canonical, length-limited Huffman code.

Ids are counted over the whole corpus; package-merge gives the code lengths (at most ``MAX_BITS``,
more only where the used ids need it), and the canonical code follows from the lengths alone. A
dataset is a Parquet folder of independent blocks in ascending document order, each with:

  part, block     order of the block;  first     ids of all documents before it
  doc_id, n_ids   its documents, in order, with their numbers of ids
  payload         the documents' bits, each beginning at a byte
  checkpoint      bit offset of every ``STRIDE``-th id of each document, from its first on

and a folder of code lengths (id, bits). Decoding looks up ``max_bits`` bits at once in a table and
runs from all checkpoints of a batch of blocks in lock step, so a reader may begin at any of them.

Defined cases: null and empty texts are the end id alone; documents of one id (ties, repeated rows)
stay apart, in the order of their rows in the written table, null ids first; an empty table gives a
dataset without blocks and codes; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import shared_dir, stage
from .tokens import SLICE, encoder
from .words import slices

MAX_BITS, STRIDE = 16, 256
#: ids in a block, at least (a block ends with a document)
BLOCK_IDS = 1 << 18
#: documents in a part on average, and parts at most; a part is sorted and written as a stream, however large
PART_DOCS, MAX_PARTS = 20_000, 1 << 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code by package-merge; 0 for unused ones."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # each level holds the leaves and the packages of the level below, by weight; leaf_before tells how many leaves precede
    levels, merged = [], weight
    for _ in range(max_bits):
        levels.append(merged)
        m = len(merged) // 2 * 2
        packages = merged[0:m:2] + merged[1:m:2]
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        merged, is_leaf = both[by], by < n
        levels[-1] = is_leaf
    # take 2n - 2 items of the last level; a package taken is two items taken below
    bits = np.zeros(n, np.int64)
    take = 2 * n - 2
    leaf_flags = [np.ones(n, bool), *levels[:-1]]
    for is_leaf in leaf_flags[::-1]:
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = bits
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Code of each symbol: by length, then by symbol."""
    used = np.flatnonzero(bits)
    used = used[np.argsort(bits[used], kind="stable")]
    codes = np.zeros(len(bits), np.uint32)
    code, last = 0, 0
    lengths = bits[used].tolist()
    values = np.empty(len(used), np.uint32)
    for k, length in enumerate(lengths):
        code <<= length - last
        values[k], last = code, length
        code += 1
    codes[used] = values
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next ``width`` bits."""
    width = max(1, int(bits.max(initial=0)))
    codes = canonical(bits)
    used = np.flatnonzero(bits)
    used = used[np.argsort(codes[used].astype(np.uint64) << (width - bits[used].astype(np.uint64)), kind="stable")]
    span = 1 << (width - bits[used].astype(np.int64))
    fill = (1 << width) - int(span.sum())
    symbols = np.concatenate([np.repeat(used, span), np.zeros(fill, np.int64)]).astype(np.uint32)
    lengths = np.concatenate([np.repeat(bits[used], span), np.ones(fill, np.uint8)]).astype(np.uint8)
    return symbols, lengths, width


def encode(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, bits: np.ndarray):
    """Bits of each document from a byte's border on: (bytes, n + 1 byte positions, bit offset of every id in its document)."""
    length = bits[ids].astype(np.int64)
    end = np.cumsum(length)
    before = end - length
    doc_bits = np.concatenate([[0], end])[at]
    sizes = -(-np.diff(doc_bits) // 8)
    byte_at = np.concatenate([[0], np.cumsum(sizes)])
    within = before - np.repeat(doc_bits[:-1], np.diff(at))
    start = within + np.repeat(byte_at[:-1] * 8, np.diff(at))
    words = np.zeros(byte_at[-1] // 8 + 2, np.uint64)
    if len(ids):
        word, stop = start >> 6, (start & 63) + length
        code = codes[ids].astype(np.uint64)
        over = stop > 64
        up, down = np.where(over, 0, 64 - stop).astype(np.uint64), np.where(over, stop - 64, 0).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat((code << up) >> down, first)
        spill = np.flatnonzero(over)
        words[word[spill] + 1] += code[spill] << (128 - stop[spill]).astype(np.uint64)
    return words.astype(">u8").tobytes()[:byte_at[-1]], byte_at, within


def decode(payload: np.ndarray, starts: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """Ids read from each bit offset on, ``counts`` (at most STRIDE) of them, one after another."""
    symbols, lengths, width = table
    data = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint64)
    # the 32 bits from each byte on
    view = ((data[:-3] << np.uint64(24)) | (data[1:-2] << np.uint64(16)) | (data[2:-1] << np.uint64(8)) | data[3:]).astype(np.uint32)
    order = np.argsort(-counts, kind="stable")
    place, left = starts[order].astype(np.int64), counts[order]
    to = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    shift, mask = np.uint32(32 - width), np.uint32((1 << width) - 1)
    active = len(left)
    for k in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left[:active], -k, side="left"))  # those with more than k ids
        here = place[:active]
        value = (view[here >> 3] >> (shift - (here & 7).astype(np.uint32))) & mask
        out[to[:active] + k] = symbols[value]
        here += lengths[value]
    return out


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A written table of row (a number), doc_id, n_ids and ids (little-endian 16 or 32 bits), one row for each document."""
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        tokens = encoder(vocabulary)
        kind = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                ids, at = tokens.documents(texts)
                size = np.dtype(kind).itemsize
                data = pa.py_buffer(ids.astype(kind).tobytes())
                offsets = pa.py_buffer((at * size).astype(np.int32).tobytes())
                rows = pa.array(row + np.arange(len(texts)))
                row += len(texts)
                yield pa.record_batch([rows, batch.column(0).slice(first, len(texts)), pa.array(np.diff(at)),
                                       pa.array(np.full(len(texts), size), pa.int32()),
                                       pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, data])],
                                      ["row", "doc_id", "n_ids", "width", "ids"])

    return stage(docs.select(F.col("doc_id").cast("long"), "text")
                 .mapInArrow(run, "row long, doc_id long, n_ids long, width int, ids binary"), "huffman-ids")


def _ids(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(raw[2], np.uint8)[at[0]:at[-1]].view(f"<u{width}"), (at - at[0]) // width


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of every id over the whole corpus; as many numbers as the vocabulary has ids."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, _ = _ids(batch.column(1), batch.column(0)[0].as_py())
                got = np.bincount(ids)
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[:len(got)] += got
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    counts[ids] = n
    return counts


def write(docs: DataFrame, path: str, vocabulary: str | None = None, max_bits: int = MAX_BITS) -> None:
    """Tokenize the documents and write the dataset below ``path``."""
    spark = docs.sparkSession
    tokens = tokenized(docs, vocabulary)
    bits = code_lengths(count_ids(tokens), max_bits)
    lengths = spark.sparkContext.broadcast(bits)
    # parts are ranges of documents by id and row, so rows of one id may be in several
    parts = max(1, min(MAX_PARTS, -(-tokens.count() // PART_DOCS)))

    def code(batches):
        codes = canonical(lengths.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            width = batch.column(3)[0].as_py()
            for first, piece in slices(batch.column(4)):
                rows = batch.slice(first, len(piece))
                ids, at = _ids(rows.column(4), width)
                data, byte_at, within = encode(ids, at, codes, lengths.value)
                marks = np.concatenate([np.arange(a, b, STRIDE) for a, b in zip(at[:-1], at[1:])])
                marks_at = np.concatenate([[0], np.cumsum(-(-np.diff(at) // STRIDE))]).astype(np.int32)
                payload = pa.Array.from_buffers(pa.binary(), len(rows), [
                    None, pa.py_buffer(byte_at.astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), payload,
                                       pa.ListArray.from_arrays(pa.array(marks_at), pa.array(within[marks].astype(np.int32)))],
                                      ["row", "doc_id", "n_ids", "payload", "checkpoint"])

    coded = tokens.select("row", "doc_id", "n_ids", "width", "ids").mapInArrow(
        code, "row long, doc_id long, n_ids long, payload binary, checkpoint array<int>")

    def blocks(batches):
        state = {"part": TaskContext.get().partitionId(), "block": 0, "before": 0, "size": 0}
        docs_, counts, data, marks = [], [], [], []

        def out():
            begin = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]]) * 8
            points = np.concatenate([m + b for m, b in zip(marks, begin)]).astype(np.int64)
            total = state["size"]
            row = pa.record_batch([pa.array([state["part"]], pa.int32()), pa.array([state["block"]], pa.int64()),
                                   pa.array([state["before"]], pa.int64()), pa.array([total], pa.int64()),
                                   pa.array([docs_[:]], pa.list_(pa.int64())), pa.array([counts[:]], pa.list_(pa.int64())),
                                   pa.array([b"".join(data)], pa.binary()), pa.array([points], pa.list_(pa.int64()))],
                                  ["part", "block", "before", "n_ids", "doc_ids", "doc_sizes", "payload", "checkpoint"])
            state["block"] += 1
            state["before"] += total
            state["size"] = 0
            for x in (docs_, counts, data, marks):
                x.clear()
            return row

        for batch in batches:
            for doc, n, payload, points in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                docs_.append(doc)
                counts.append(n)
                state["size"] += n
                data.append(payload.as_py())
                marks.append(points.values.to_numpy())
                if state["size"] >= BLOCK_IDS:
                    yield out()
        if docs_:
            yield out()

    kind = ("part int, block long, before long, n_ids long, doc_ids array<long>, doc_sizes array<long>, "
            "payload binary, checkpoint array<long>")
    (coded.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(blocks, kind)
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    spark.createDataFrame(pa.table({"id": pa.array(np.flatnonzero(bits)), "bits": pa.array(bits[bits > 0].astype(np.int32))})
                          ).coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a dataset, decoded: doc_id, start, n_tokens, ids_crc32, and the ids when asked for."""
    rows = spark.read.parquet(f"{path}/code").toArrow()  # as many rows as the vocabulary has ids, at most
    bits = np.zeros(int(max(rows["id"].to_pylist(), default=-1)) + 1, np.uint8)
    bits[rows["id"].to_numpy()] = rows["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    # ids before each part: one number a part
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    firsts = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)).alias("part_first"))

    def run(batches):
        table = decode_table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                first, doc_ids, sizes, payload, marks = (batch.column(c)[k] for c in range(5))
                sizes = sizes.values.to_numpy()
                marks = marks.values.to_numpy()
                last = np.cumsum(-(-sizes // STRIDE)) - 1
                counts = np.full(len(marks), STRIDE)
                counts[last] = sizes - (-(-sizes // STRIDE) - 1) * STRIDE
                ids = decode(np.frombuffer(payload.as_buffer(), np.uint8), marks, counts, table)
                at = np.concatenate([[0], np.cumsum(sizes)])
                data = memoryview(ids.astype("<u4").tobytes())
                pieces = [data[4 * a:4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = [doc_ids.values, pa.array(first.as_py() + at[:-1]), pa.array(sizes),
                           pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(p) for p in pieces], pa.binary()))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return (blocks.join(F.broadcast(firsts), "part")
            .select((F.col("part_first") + F.col("before")).alias("first"), "doc_ids", "doc_sizes", "payload", "checkpoint")
            .mapInArrow(run, kind))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' ids to a fresh dataset in the shared folder and read it back."""
    path = f"{shared_dir(docs.sparkSession)}/huffman-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
