"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

The test items are the stated, small side: they are indexed in blocks of at most ``block_bytes`` of
text, each block one broadcast, and every training document is read against each. Impacts are BM25
term scores divided by the score of the item against itself, so a passage that holds the whole item
scores 1 and one threshold serves all items. A passage is a window of words twice as long as the
longest item of the block, moved by half of it, so each item lies whole in some window.

Search of a passage: frequent terms, which all together stay below a share of the threshold on every
item, can't make a hit alone. Over the other terms the block maxima bound what each block of items can
reach; passages with no block that can reach the threshold are left, for whole batches at once. The
others are walked by block-max WAND. Every item at or above the threshold is retrieved (no top k) and verified:
a document is contaminated by an item when the passage holds at least ``overlap`` of the distinct
five-word shingles of the item's question and of its answer. The answer is the item's last
sentence; an item of one sentence is cut after three quarters of its words.

Words are runs of bytes other than ASCII punctuation and white space, with A-Z lowered. Defined cases:
null, empty and wordless texts match nothing; items without words are never found; repeated items
are found each, repeated documents are searched each; without items nothing is found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, mix, slices, span_hashes, utf8_batch, word_bounds

THRESHOLD, OVERLAP, SIZE = 0.7, 0.8, 5
#: share of the threshold that the frequent terms may reach together
FREQUENT_SHARE = 0.55
BLOCK_BYTES = 8 << 20
#: items whose postings share one maximum
ITEMS_PER_BLOCK = 16
K1, B = 1.2, 0.75

_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and their n + 1 positions; punctuation counts as white space."""
    raw, offsets = utf8_batch(column)
    raw = _PLAIN[raw]
    starts, ends = word_bounds(raw, offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if re.search(r"[^\s!-/:-@\[-`{-~]", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = max(1, len(words) * 3 // 4)
    return " ".join(words[:at]), " ".join(words[at:])


@dataclass
class Index:
    """Postings by term, items ascending: item ``items[k]`` has impact ``impact[k]`` for k in [at[t], at[t + 1])."""

    ids: np.ndarray         # item ids
    terms: np.ndarray       # sorted word hashes
    at: np.ndarray
    items: np.ndarray
    impact: np.ndarray
    block_max: np.ndarray   # terms x blocks of items
    rare: np.ndarray        # terms without which no item reaches the threshold
    block_need: np.ndarray  # terms x blocks: largest share of what an item needs beyond its frequent terms
    threshold: float
    window: int             # words of half a passage
    questions: list         # of each item (distinct hashes of its runs of words, their size)
    answers: list


def build_index(ids: list, texts: list, threshold: float = THRESHOLD) -> Index:
    """An index of the items that have words."""
    words, at = plain_words(pa.array(texts, pa.string()))
    some = np.flatnonzero(np.diff(at) > 0)
    # items of like length share blocks, so that their maxima are close to their impacts
    some = some[np.argsort(np.diff(at)[some], kind="stable")]
    lengths = np.diff(at)[some].astype(float)
    item = np.repeat(np.arange(len(some)), np.diff(at)[some])
    inside = np.concatenate([np.arange(at[i], at[i + 1]) for i in some]) if len(some) else np.zeros(0, np.int64)
    terms, term = np.unique(words[inside], return_inverse=True)
    pair, count = np.unique(term * max(len(some), 1) + item, return_counts=True)
    term, item = pair // max(len(some), 1), pair % max(len(some), 1)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(some) - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1)) if len(some) else lengths
    impact = idf[term] * count * (K1 + 1) / (count + norm[item]) if len(some) else np.zeros(0)
    impact = impact / np.bincount(item, impact, len(some))[item] if len(some) else impact
    blocks = -(-len(some) // ITEMS_PER_BLOCK)
    block_max = np.zeros((len(terms), blocks), np.float32)
    np.maximum.at(block_max, (term, item // ITEMS_PER_BLOCK), np.nextafter(impact.astype(np.float32), np.float32(2)))
    # the most terms, by falling frequency, that stay below their share of the threshold on every item
    for most in np.unique(np.concatenate([[0], df])):
        frequent = np.bincount(item, impact * (df > most)[term], len(some))
        if len(some) == 0 or frequent.max() <= FREQUENT_SHARE * threshold:
            break
    rare = df <= most
    block_need = np.zeros_like(block_max)
    need = impact * rare[term] / (threshold - frequent)[item] if len(some) else impact
    np.maximum.at(block_need, (term, item // ITEMS_PER_BLOCK), need.astype(np.float32))
    parts = [question_and_answer(texts[i]) for i in some]

    def sets(side: int) -> list[tuple[np.ndarray, int]]:
        w, a = plain_words(pa.array([p[side] for p in parts], pa.string()))
        sizes = np.minimum(np.diff(a), SIZE).tolist()
        return [(np.unique(runs(w[i:j], n)), n) for i, j, n in zip(a[:-1], a[1:], sizes)]

    return Index(np.asarray(ids, object)[some], terms, np.concatenate([[0], np.cumsum(df)]), item, impact, block_max,
                 rare, block_need, threshold, int(max(32, lengths.max())) if len(some) else 32, sets(0), sets(1))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of 0 words there are none."""
    n = len(words) - size + 1
    if size == 0 or n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items at or above the threshold for a passage of distinct terms."""
    items, impact, block_max = index.items, index.impact, index.block_max
    cursors = [[int(items[index.at[t]]), int(index.at[t]), int(index.at[t + 1]), int(t), float(block_max[t].max())]
               for t in terms]
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c[4]
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // ITEMS_PER_BLOCK
        here = cursors[:pivot + 1]
        if sum(float(block_max[c[3], block]) for c in here) < threshold:
            # no item before the block's end, or before the next cursor's item, can reach it
            goal = (block + 1) * ITEMS_PER_BLOCK
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][0])
            goal = max(goal, item + 1)
        elif cursors[0][0] == item:
            score = sum(float(impact[c[1]]) for c in here)
            if score >= threshold:
                found.append((item, score))
            goal = item + 1
        else:
            goal = item
        for c in here:
            if c[0] < goal:
                c[1] += int(np.searchsorted(items[c[1]:c[2]], goal))
                c[0] = int(items[c[1]]) if c[1] < c[2] else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def _held(passages: dict, part: tuple[np.ndarray, int]) -> float:
    """Share of a question's or answer's runs in the passage whose runs are kept by size; 1 if it has none."""
    wanted, size = part
    if size not in passages:
        passages[size] = runs(passages["words"], size)
    return float(np.isin(wanted, passages[size]).mean()) if len(wanted) else 1.0


def search(index: Index, column: pa.Array, overlap: float = OVERLAP):
    """(row, item number, score, question overlap, answer overlap) of all verified hits; the best window of each."""
    if not len(index.terms):
        return
    half, width = index.window, len(index.terms)
    for first, texts in slices(column, 1 << 20):
        words, at = plain_words(texts)
        place = np.minimum(np.searchsorted(index.terms, words), width - 1)
        known = np.flatnonzero(index.terms[place] == words)
        if not len(known):
            continue
        term = place[known]
        row = np.searchsorted(at, known, side="right") - 1
        half_at = np.concatenate([[0], np.cumsum(-(-np.diff(at) // half))])
        part = half_at[row] + (known - at[row]) // half
        last = np.zeros(half_at[-1], bool)
        last[half_at[1:][np.diff(half_at) > 0] - 1] = True
        # a window is a half and the next one of the same text: each rare term counts once in either of its two
        rare = index.rare[term]
        p, q = part[rare], term[rare]
        second = (p > 0) & ~last[p - 1]
        both = np.unique(np.concatenate([p * width + q, (p[second] - 1) * width + q[second]]))
        if not len(both):
            continue
        window, q = both // width, both % width
        new = np.flatnonzero(np.diff(window, prepend=-1))
        reach = np.add.reduceat(index.block_need[q], new, axis=0).max(1)
        hopeful = window[new][reach >= 0.9999]
        best = {}
        for s in hopeful.tolist():
            r = int(np.searchsorted(half_at, s, side="right")) - 1
            stop = s + (1 if last[s] else 2)
            lo, hi = np.searchsorted(part, s), np.searchsorted(part, stop)
            hits = wand(index, np.unique(term[lo:hi]), index.threshold)
            if not hits:
                continue
            a = at[r] + (s - half_at[r]) * half
            passage = {"words": words[a:min(a + 2 * half, at[r + 1])]}
            for item, score in hits:
                question, answer = _held(passage, index.questions[item]), _held(passage, index.answers[item])
                if question >= overlap and answer >= overlap and best.get((r, item), (0,))[0] < score:
                    best[r, item] = (score, question, answer)
        for (r, item), values in sorted(best.items()):
            yield first + r, item, *values


def _blocks(items: DataFrame, block_bytes: int):
    """Blocks of (ids, texts) of the items, by hash, of about ``block_bytes`` each."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        yield rows["item_id"].to_pylist(), rows["text"].to_pylist()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verified hits: doc_id, item_id, score, question_overlap, answer_overlap; one row for a document row and item."""
    spark = docs.sparkSession
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], kind)
    for ids, texts in _blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(build_index(ids, texts, threshold))
        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_hits(shared, overlap), kind))
    return out


def _hits(shared, overlap: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            hits = list(search(index, batch.column(1), overlap))
            if hits:
                row, item, score, question, answer = zip(*hits)
                yield pa.record_batch([batch.column(0).take(pa.array(row)),
                                       pa.array([index.ids[i] for i in item], pa.int64()), pa.array(score),
                                       pa.array(question), pa.array(answer)],
                                      ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _free(shared, overlap: float):
    @F.arrow_udf("boolean")
    def free(text: pa.Array) -> pa.Array:
        out = np.ones(len(text), bool)
        out[[hit[0] for hit in search(shared.value, text, overlap)]] = False
        return pa.array(out)

    return free


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    for ids, texts in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(ids, texts, threshold))
        docs = docs.where(_free(shared, overlap)(F.col("text")))
    return docs
