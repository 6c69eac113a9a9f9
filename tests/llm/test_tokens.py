"""Ids by pieces equal the library's ids of the whole texts."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callsight.llm.tokens import PieceEncoder
from callsight.llm.words import shingles, slices, words_of


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder()


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def held(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert at[-1] == len(ids)
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == direct(encoder, text), text


def test_odd_texts(encoder):
    held(encoder, ["", None, " ", "Hello, WORLD. it's o'clock's, x.,. <|endoftext|>, a<|ENDOFTEXT|>", "H̱ Été x, ́a é. é, ×, ÷.",
                   "　z ﬁ İI. Å, don't. 've 123,456. ... ,. a.b.  q", "x" * 5000, "\x0b\x0c\x1c y\x1dz, \x85w",
                   "a\x00b ,", "it's,", "日本語. テスト, ß. ẞ ſ", "\U0001f600. \U0001f600,"])


def test_repeated_calls_and_small_table(encoder, monkeypatch):
    import callsight.llm.tokens as t

    monkeypatch.setattr(t, "SLOTS", 64)
    monkeypatch.setattr(t, "MAX_IDS", 500)
    small = PieceEncoder()
    rng = np.random.default_rng(3)
    for _ in range(20):
        held(small, [" ".join(rng.choice(["the", "of", "Thing,", "éa.", "word%d" % rng.integers(300), "x!!"], 40)) for _ in range(5)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n.,'<|>aAzZéÉ!9")), max_size=40), max_size=5))
def test_any_text(encoder, texts):
    held(encoder, texts)


def test_end_ids(encoder):
    ids, at = encoder.documents(pa.array(["a b", None, "c"]))
    assert np.diff(at).tolist() == [3, 1, 2]
    assert ids[at[1:] - 1].tolist() == [2, 2, 2]


def test_slices_keep_all_rows():
    column = pa.array(["a" * 10, None, "b" * 50, "", "c"])
    got = [(k, p.to_pylist()) for k, p in slices(column, 20)]
    assert [x for _, p in got for x in p] == column.to_pylist()
    assert [k for k, _ in got] == np.cumsum([0, *[len(p) for _, p in got]])[:-1].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n", max_size=30), max_size=6))
def test_shingles_are_those_of_words(texts):
    import re

    words, at = words_of(pa.array(texts, pa.string()))
    hashes, where = shingles(words, at)
    seen = {}
    for k, text in enumerate(texts):
        want = re.findall("[^\x20\x09-\x0d]+", text.lower())
        assert at[k + 1] - at[k] == len(want)
        lists = [tuple(want[i:i + 5]) for i in range(max(1, len(want) - 4))] if want else []
        assert where[k + 1] - where[k] == len(lists)
        for s, h in zip(lists, hashes[where[k]:where[k + 1]].tolist()):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)
