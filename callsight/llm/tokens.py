"""Whole-text tokenizing of Arrow batches with the ``tokenizers`` library.

The word-level vocabulary drops white space, so no token spans it and the ids of a text
are those of its pieces, one after another. Each distinct piece is given to the library
once per worker and remembered in a direct-mapped table keyed by its 64-bit hash; the ids
of a batch are then gathered with numpy. Pieces end at ASCII white space and before a
final comma or full stop that follows a Latin letter; pieces of plain ASCII are lowered
first, as the vocabulary's own normalizer does. ``tests/llm/test_tokens.py`` holds the
result against the library's ids of the whole texts.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import LOWER, span_hashes, utf8_batch, word_bounds

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: slots of a worker's piece table, and ids remembered before it starts afresh
SLOTS = 1 << 21
MAX_IDS = 1 << 23
#: bytes of text that are encoded at once; a few dozen times as much is held meanwhile
SLICE = 1 << 20
#: Latin letters that are single code points in either case
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of texts by way of their distinct pieces. Holds at most SLOTS pieces and MAX_IDS ids."""

    def __init__(self, path: str | None = None):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        # words of one kind of letters only are one pre-token: the same model without the general split pattern
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.where = np.zeros(SLOTS, np.int32)
        self.sizes = np.zeros(SLOTS, np.int32)
        self.ids = np.empty(1 << 20, np.uint32)
        self.used = 0

    @staticmethod
    def _second(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Of the two slots a piece may have, the one that holds it, else either."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        other = np.flatnonzero(self.keys[slot] != hashes)
        slot[other] = self._second(hashes[other])
        return slot

    def _encode_new(self, raw, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        data = raw.tobytes()
        pieces = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        simple = np.fromiter((_LETTERS(x) is not None for x in pieces), bool, len(pieces))
        lines = [x.lower() for x, s in zip(pieces, simple) if s]
        got = self.letters.encode_batch_fast([" ".join(lines[k:k + 500]) for k in range(0, len(lines), 500)],
                                             add_special_tokens=False)
        flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in got] or [np.zeros(0, np.uint32)])
        last = np.flatnonzero(self.ends_word[flat]) + 1
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([x for x, s in zip(pieces, simple) if not s],
                                                                add_special_tokens=False)]
        sizes = np.empty(len(pieces), np.int32)
        sizes[simple] = np.diff(last, prepend=0)
        sizes[~simple] = np.fromiter(map(len, rest), np.int32, len(rest))
        out = np.empty(int(sizes.sum()), np.uint32)
        of_letters = np.repeat(simple, sizes)
        out[of_letters] = flat
        out[~of_letters] = np.fromiter(chain.from_iterable(rest), np.uint32)
        return out, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (no end ids), and n + 1 positions."""
        raw, offsets = utf8_batch(column)
        starts, ends = word_bounds(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # pieces of ASCII without "<" are lowered, and lose a final [.,] that follows a letter
        odd = np.concatenate([[0], np.cumsum((raw >= 0x80) | (raw == 0x3C), dtype=np.int32)])
        plain = odd[ends] == odd[starts]
        last, before = raw[ends - 1], LOWER[raw[np.maximum(ends - 2, 0)]]
        letter = (before >= 0x61) & (before <= 0x7A) & (ends - starts > 1)
        letter |= (ends - starts > 2) & (raw[np.maximum(ends - 3, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
        split = ((last == 0x2C) | (last == 0x2E)) & letter
        low = LOWER[raw]
        if not plain.all():
            keep = np.zeros(len(raw) + 1, np.int8)
            keep[starts[~plain]] += 1
            keep[ends[~plain]] -= 1
            kept = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
            low[kept] = raw[kept]
        size = 1 + split
        piece_at = np.cumsum(size) - size
        a = np.empty(int(size.sum()), np.int64)
        b = np.empty_like(a)
        a[piece_at], b[piece_at] = starts, ends - split
        tail = piece_at[split] + 1
        a[tail], b[tail] = ends[split] - 1, ends[split]
        hashes = span_hashes(low, a, b)
        slot = self._slots(hashes)
        new = np.flatnonzero(self.keys[slot] != hashes)
        over_where = over_size = None
        if len(new):
            distinct, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            flat, sizes = self._encode_new(low, a[at], b[at])
            if self.used + len(flat) > MAX_IDS:
                self._reset()
                new = np.arange(len(hashes))
                distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                flat, sizes = self._encode_new(low, a[first], b[first])
            if self.used + len(flat) > len(self.ids):
                grown = np.empty(max(2 * len(self.ids), self.used + len(flat)), np.uint32)
                grown[:self.used] = self.ids[:self.used]
                self.ids = grown
            self.ids[self.used:self.used + len(flat)] = flat
            places = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            self.used += len(flat)
            over_where, over_size = places[inverse], sizes[inverse]
        where, count = self.where[slot].astype(np.int64), self.sizes[slot].astype(np.int64)
        if over_where is not None:
            where[new], count[new] = over_where, over_size
            home = (distinct & np.uint64(SLOTS - 1)).astype(np.int64)
            home = np.where(self.keys[home] != 0, self._second(distinct), home)
            self.keys[home], self.where[home], self.sizes[home] = distinct, places, sizes
        ends_at = np.cumsum(count)
        ids = self.ids[np.repeat(where - (ends_at - count), count) + np.arange(ends_at[-1])]
        text_piece = np.concatenate([piece_at, [len(a)]])[np.searchsorted(starts, offsets)]
        return ids, np.concatenate([[0], ends_at])[text_piece]

    def documents(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        ids, at = self.encode(column)
        n = len(at) - 1
        out_at = at + np.arange(n + 1)
        out = np.empty(out_at[-1], np.uint32)
        mask = np.ones(len(out), bool)
        mask[out_at[1:] - 1] = False
        out[mask], out[~mask] = ids, end_id
        return out, out_at


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


__all__ = ["END_ID", "PieceEncoder", "VOCABULARY", "encoder", "vocabulary_path"]
