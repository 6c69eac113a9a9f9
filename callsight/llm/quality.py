"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text is summarised by a few dozen numbers computed for a whole Arrow batch at once
(shares of byte classes, word and line shape, repetition). Trees are grown on the driver
from quantile-binned statistics of at most ``max_rows`` labelled documents (a documented
bound: 20,000 rows of 27 floats) and flattened into arrays; scoring walks all trees of a
batch with numpy, one level at a time.

Defined cases: null and empty texts have all statistics 0 and get a score like any other;
labels that are null are ignored, several labels of one document count as their maximum;
without labels, or with one class only, the score is the smoothed share of label 1 (0.5
without labels); repeated rows are scored each; other columns are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, mix, slices, span_hashes, utf8_batch, word_bounds

THRESHOLD = 0.3
MAX_TRAINING_ROWS = 20_000

#: byte classes: the statistics hold each one's share of a text
_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": [0x20, 9, 11, 12, 13],
    "line": [0x0A], "stop": [0x2E, 0x3F], "comma": [0x2C, 0x3B, 0x3A], "bang": [0x21], "pipe": [0x7C],
    "symbol": list(b"#$%&*@^~+=<>\\/_`"), "bracket": list(b"()[]{}\"'-"), "wide": range(0x80, 0x100),
}
STATISTICS = [*_CLASSES, "bytes", "words", "word_bytes", "word_bytes_sd", "long_words", "capital_words", "upper_words",
              "same_as_last", "distinct_words", "distinct_pairs", "bytes_per_line", "repeated_lines",
              "end_symbol", "end_bang", "end_stop"]
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k + 1
_N_CLASSES = len(_CLASSES) + 1


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, whose values lie between its positions."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct keys of each text."""
    n = len(at) - 1
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    bits = np.uint64(max(1, int(n).bit_length()))
    with np.errstate(over="ignore"):
        both = np.sort((text << (np.uint64(64) - bits)) | (mix(keys) >> bits))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return np.bincount((both[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)[:n].astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    parts = [_statistics(piece) for _, piece in slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)


def _statistics(column: pa.Array) -> np.ndarray:
    raw, offsets = utf8_batch(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)), np.float32)
    if not len(raw):
        return out
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n, dtype=np.int32), size)
    counts = np.bincount(text_of * _N_CLASSES + _CLASS_OF[raw], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    out[:, :len(_CLASSES)] = counts[:, 1:] / np.maximum(size, 1)[:, None]
    starts, ends = word_bounds(raw, offsets)
    at = np.searchsorted(starts, offsets)
    words = np.diff(at)
    some = np.maximum(words, 1)
    lengths = (ends - starts).astype(np.float64)
    mean = _per_text(lengths, at) / some
    hashes = span_hashes(LOWER[raw], starts, ends)
    first, last = _CLASS_OF[raw[starts]], _CLASS_OF[raw[ends - 1]]
    upper = np.concatenate([[0], np.cumsum(_CLASS_OF[raw] == 1)])
    uppers = upper[ends] - upper[starts]
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[:-1][words > 0]] = 0
    with np.errstate(over="ignore"):
        pairs = hashes.copy()
        pairs[1:] += hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    breaks = np.flatnonzero(raw == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_at = np.searchsorted(line_starts, offsets)
    line_ends = np.concatenate([line_starts[1:], [len(raw)]])
    line_ends = line_ends - (raw[line_ends - 1] == 0x0A)
    lines = np.maximum(np.diff(line_at), 1)
    columns = [
        np.log1p(size), np.log1p(words), mean,
        np.sqrt(np.maximum(_per_text(lengths ** 2, at) / some - mean ** 2, 0)),
        _per_text(lengths > 20, at) / some, _per_text(first == 1, at) / some,
        _per_text((uppers > 1) & (uppers * 2 > lengths), at) / some, _per_text(same, at) / some,
        _distinct(hashes, at) / some, _distinct(pairs, at) / some, size / lines,
        1 - _distinct(span_hashes(raw, line_starts, line_ends), line_at) / lines,
        _per_text(last == 10, at) / some, _per_text(last == 8, at) / some, _per_text(last == 6, at) / some,
    ]
    for k, values in enumerate(columns):
        out[:, len(_CLASSES) + k] = values
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth, level by level: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a row goes right when its value is above
    value: np.ndarray      # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        inner = self.feature.shape[1]
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15,
        bins: int = 64, min_weight: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, grown from gradient histograms of binned columns."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    cell = binned + np.arange(width) * bins
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            flat = ((node - first)[:, None] * (width * bins) + cell).ravel()
            g = np.bincount(flat, np.repeat(grad, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            h = np.bincount(flat, np.repeat(hess, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g ** 2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g ** 2 / (all_h + ridge)
            gain[(h < min_weight) | (all_h - h < min_weight)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def held_out(doc_id):
    """One document in five, by the checksum of its id, is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Learn from at most ``max_rows`` labelled documents, those with the smallest hashed ids."""
    wanted = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(label).cast("double").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def summarise(batches):
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "y"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "_label")
            .mapInArrow(summarise, "x binary, y double").toArrow())
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy()
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, np.int64)
    return fit(x[order].astype(np.float64), y[order])


def scorer(model: Trees):
    """Column function: score of a text column."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(text).astype(np.float64)))

    return score


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold up) of every document."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    return docs.where(scorer(model)(F.col("text")) >= threshold)
