import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortvec.llm import words as w

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\nÉß\x0b", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    got = w.split_words(pa.array(texts, pa.string()))
    assert len(got.counts) == len(texts)
    for i, text in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        assert got.of(i) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["aa", "b", "É", "c"]), min_size=1, max_size=40), st.integers(1, 5))
def test_windows_hash_alike_if_and_only_if_equal(tokens, size):
    words = w.split_words(pa.array([" ".join(tokens), "\n".join(tokens)]))
    at = w.window_starts(words, size)
    hashes = w.rolling(words.hash, size)[at]
    flat = tokens + tokens
    sequences = [tuple(flat[i : i + size]) for i in at]
    assert len(set(hashes.tolist())) == len(set(sequences))
    assert len(at) == 2 * max(len(tokens) - size + 1, 0)


def thue_morse(a, b, doublings=10):
    """Two strings that every polynomial hash modulo a power of two takes for equal."""
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_whose_polynomials_agree():
    words = [*thue_morse("a", "b"), *thue_morse("x", "q", 8), *thue_morse("cd", "dc")]
    words += ["a" * n for n in (1, 7, 8, 9, 16, 17, 511, 512, 513, 5000)] + ["\0", "\0\0", "a\0"]
    hashes = w.split_words(pa.array([" ".join(words)])).hash
    assert len(hashes) == len(words) == len(set(hashes.tolist()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abé\0", min_size=1, max_size=1200), min_size=1, max_size=5))
def test_hashes_depend_on_the_word_alone(words):
    together = w.split_words(pa.array(["zz", " ".join(words)])).hash[1:]
    alone = [w.split_words(pa.array([x])).hash[0] for x in words]
    assert together.tolist() == [int(h) for h in alone]
    assert len(set(together.tolist())) == len(set(words))


def test_sliced_and_chunked_columns():
    column = pa.chunked_array([["zero", "one two"], [None, "three"]])
    assert w.split_words(column).of(1) == [b"one", b"two"]
    assert w.split_words(pa.array(["a", "b c", "d"]).slice(1, 1)).of(0) == [b"b", b"c"]


def test_planes_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    assert np.array_equal(w.from_planes(w.planes(values)), values)


def test_groups_of_rows_keep_whole_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "c"]})
    parts = list(w.groups_of_rows(batch, "text", 20))
    assert [p.num_rows for p in parts] == [2, 1, 1]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
