"""Running top-k of many queries over streamed rows, inside a task."""

from __future__ import annotations

import numpy as np

#: entries of a distance matrix, or of a block of vectors, at a time
CELLS = 1 << 19


def slices(rows: int, queries: int, dim: int = 1):
    """(first, end) of row slices whose distance matrix to all queries, and whose vectors, stay below ``CELLS`` entries."""
    step = max(1, CELLS // max(queries, dim, 1))
    for first in range(0, rows, step):
        yield first, min(rows, first + step)


class RunningTopK:
    """The k rows of least (key, id) for each query, over any number of blocks of rows.

    Only entries that can still be among the k are kept, as flat lists that are compacted now and
    then, so the memory is a few times queries x k."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit, self.parts, self.held = k, np.full(queries, np.inf), [], 0
        self.room = max(1 << 18, 4 * queries * k)

    def add(self, keys: np.ndarray, distances: np.ndarray, ids: np.ndarray, which: np.ndarray | None = None) -> None:
        """A block: keys and distances (rows x queries), ids of the rows; which queries the columns are."""
        if not keys.size:
            return
        which = np.arange(keys.shape[1]) if which is None else which
        limit = self.limit[which]
        if len(keys) >= self.k:
            limit = np.minimum(limit, np.partition(keys, self.k - 1, axis=0)[self.k - 1])
        r, c = np.nonzero(keys <= limit)
        self.parts.append((which[c], keys[r, c], distances[r, c], ids[r]))
        self.held += len(r)
        if self.held > self.room:
            self._compact()

    def _compact(self) -> None:
        if not self.parts:
            return
        q, key, distance, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, key, q))
        q, key, distance, ids = q[order], key[order], distance[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.limit[q[full]] = key[full]
        keep = place < self.k
        self.parts = [(q[keep], key[keep], distance[keep], ids[keep])]
        self.held = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id), at most k entries a query."""
        self._compact()
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=str)
        q, _, distance, ids = self.parts[0]
        return q, distance, ids
