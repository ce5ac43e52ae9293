"""The registered queries that SQL cannot express, on the smallest tables."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortvec.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_names():
    assert set(QUERIES) - set(ORACLES) == {"op4_packing", "op6_language_id", "op9_token_output", "op10_toxicity", "op11_byte_bpe"}


def test_pieces(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_packing"](spark, FOLDER).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        end = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (end, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[end : end + r.length].tobytes())
            end += r.length
        assert end == len(ids)
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r.length for own in pieces.values() for r in own)
    assert len(sequences) * 2048 <= 1.05 * total


@pytest.mark.parametrize(("name", "fold", "out"), [("op6_language_id", 5, 0), ("op10_toxicity", 4, 2)])
def test_folds_and_scores(spark, texts, name, fold, out):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == out)
        assert 0 <= r.score <= 1
    if name == "op6_language_id":
        langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
        assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.9
    else:
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)
