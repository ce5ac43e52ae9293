import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortvec.llm import byte_bpe as b
from cohortvec.llm.queries import QUERIES
from cohortvec.llm.words import string_bytes

PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "ß", "1", "²", "!", "…", "漢", "😀", "　", " ", "\0", "́", "Z", "Ⅷ"]


@pytest.fixture(scope="module")
def words():
    return b.vocabulary(public_tokenizers.path(b.RANKS))


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def encoded(words, texts):
    raw, offsets = string_bytes(pa.array(texts, pa.string()))
    starts, first = b.split_pieces(raw, offsets)
    data = raw.tobytes()
    flat, counts = words.encode_pieces([data[x:y] for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])])
    at = np.concatenate([[0], np.cumsum(counts)])[first]
    return [flat[x:y].tolist() for x, y in zip(at, at[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=20))
def test_ids_are_those_of_the_library(words, library, texts):
    assert encoded(words, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(words, library, text):
    assert encoded(words, [text]) == [library.encode_ordinary(text)]


def test_long_pieces(words, library):
    draw = random.Random(3).choice
    texts = ["ab" * 700, "x" * 5000 + "'s" * 40, "=" * 3000, "".join(draw("abcdeé") for _ in range(9000)), " " * 2500 + "a"]
    assert encoded(words, texts) == [library.encode_ordinary(t) for t in texts]
    assert max(len(t) for t in texts) > 4 * b.LONGEST_ROW


def small_vocabulary(extra):
    ranks = {bytes([x]): x for x in range(256)}
    return b.Vocabulary(ranks | {word: 256 + i for i, word in enumerate(extra)})


def plain_merges(ranks, piece):
    """Merge the leftmost pair of least rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([x]) for x in piece]
    while True:
        best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.binary(min_size=2, max_size=5).map(lambda x: bytes(97 + c % 3 for c in x)), unique=True, max_size=25),
    st.lists(st.text(alphabet="abc", min_size=1, max_size=40), min_size=1, max_size=8),
)
def test_any_order_of_ranks(extra, texts):
    """A longer word may have a lower rank than its parts; both ways follow the plain rule."""
    words = small_vocabulary(extra)
    pieces = [t.encode() for t in texts]
    flat, counts = words.encode_pieces(pieces)
    want = [plain_merges(words.ranks, p) for p in pieces]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]
    for piece in pieces:
        if piece not in words.ranks:
            assert words.merge_long(piece) == plain_merges(words.ranks, piece)


def test_pairs_that_share_a_slot():
    left, right = np.arange(3000) % 60, np.arange(3000) // 60
    table = b.PairTable(left, right, np.arange(3000))
    assert table.find(left, right).tolist() == list(range(3000))
    assert (table.find(left + 60, right) == b.NONE).all()


def test_rows(spark, documents, library, long_text):
    texts = {1: None, 2: "", 3: "it's  here\n", 4: "é" * 3000, 5: long_text, None: "no id"}
    docs = documents([*texts.items(), (3, texts[3])])
    rows = b.decode_ids(b.encode_texts(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == (texts[r.doc_id] or "").encode()


def test_empty_table_and_errors(spark, documents):
    encoded_rows = b.encode_texts(documents([]))
    assert b.decode_ids(encoded_rows).collect() == []
    with pytest.raises(ValueError, match="already"):
        b.decode_ids(encoded_rows, decoded_col="ids")
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        b.decode_ids(bad).collect()


def test_query(spark, library):
    import hashlib

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
