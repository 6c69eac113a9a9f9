"""Which texts hold which needles, and where first: one automaton for a block of needles, one pass over the texts a block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: characters of the needles of one automaton, about
BLOCK_CHARS = 1 << 20
#: texts whose hits a task holds at a time
ROWS = 128


def _held(shared):
    """(row, needle) of rows (row, text), each needle of the block once a text."""
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        find = ahocorasick.Automaton()
        for needle in shared.value:
            find.add_word(needle, needle)
        find.make_automaton()
        for batch in (given.slice(k, ROWS) for given in batches for k in range(0, given.num_rows, ROWS)):
            rows, needles = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {needle for _, needle in find.iter(text)}
                rows += [row] * len(found)
                needles += sorted(found)
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(needles, pa.string())], ["_row", "_needle"])

    return run


def _blocks(needles: DataFrame, needle_key: str):
    """The distinct needles in lists of about ``BLOCK_CHARS`` characters, dealt by hash; each broadcast."""
    wanted = staged(needles.where(F.length(needle_key) > 0).select(F.col(needle_key).alias("_needle")).distinct(), "pattern-needles")
    size = wanted.agg(F.coalesce(F.sum(F.length("_needle")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    for b in range(blocks):
        block = [r[0] for r in wanted.where(F.pmod(F.xxhash64("_needle"), F.lit(blocks)) == b).collect()]
        if block:
            yield needles.sparkSession.sparkContext.broadcast(block)


def _first(shared, window: int):
    """(row, needle, before) of rows (row, text): the characters in front of each needle's first place."""
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        find = ahocorasick.Automaton()
        for k, needle in enumerate(shared.value):
            find.add_word(needle, k)
        find.make_automaton()
        sizes = [len(needle) for needle in shared.value]
        for batch in (given.slice(k, ROWS) for given in batches for k in range(0, given.num_rows, ROWS)):
            row_of, needles, before = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                first: dict[int, int] = {}
                for end, k in find.iter(text or ""):
                    first.setdefault(k, end)
                for k, end in first.items():
                    begin = end + 1 - sizes[k]
                    row_of.append(n)
                    needles.append(shared.value[k])
                    before.append(text[max(0, begin - window):begin])
            yield pa.record_batch([batch.column(0).take(pa.array(row_of, pa.int64())), pa.array(needles, pa.string()),
                                   pa.array(before, pa.string())], ["_row", "_needle", "_before"])

    return run


def first_places(texts: DataFrame, id_key: str, text_key: str, needles: DataFrame, needle_key: str, window: int) -> DataFrame:
    """_row (the id), _needle and _before of every row of texts and needle that it holds: the ``window`` characters in
    front of the needle's first place. Rows of equal ids stay apart; only ids, needles and windows leave the tasks."""
    rows = texts.select(F.col(id_key).alias("_row"), text_key)
    kind = f"_row {rows.schema['_row'].dataType.simpleString()}, _needle string, _before string"
    found = [rows.mapInArrow(_first(block, window), kind) for block in _blocks(needles, needle_key)]
    return reduce(DataFrame.union, found) if found else texts.sparkSession.createDataFrame([], kind)


def substring_pairs(texts: DataFrame, text_key: str, needles: DataFrame, needle_key: str) -> DataFrame:
    """Exact pairs (text row, needle row) where ``needle`` is a substring of ``text``; no pair for an empty needle.

    Distinct needles are dealt by hash into blocks of bounded size. A block is broadcast as a list, every task
    builds its automaton and runs it over its texts; only row numbers and needles leave the tasks. Rows are
    joined on afterwards."""
    spark = texts.sparkSession
    rows = staged(texts.where(F.col(text_key).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "pattern-texts")
    found = [rows.select("_row", text_key).mapInArrow(_held(block), "_row long, _needle string") for block in _blocks(needles, needle_key)]
    hits = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "_row long, _needle string")
    return hits.join(rows, "_row").drop("_row").join(needles, F.col("_needle") == needles[needle_key]).drop("_needle")
