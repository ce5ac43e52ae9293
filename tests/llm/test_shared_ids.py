"""Ids, and null, that hold more than a block of ``op1``."""

import random

import pytest
from pyspark.sql import functions as F

from cohortvec.llm.substring_dedup import blocks_of_rows

from .test_substring_dedup import check


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    passages = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(6)]
    ids = [None] * 60 + [7] * 50 + [8] * 30 + list(range(-20, 20))
    out = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(30))) + " " + rng.choice(passages)) for i in ids]
    head = "same head " * 20
    return out + [(7, head + p) for p in passages] + [(7, "copy of a row with a few words")] * 20 + [(None, None), (7, None), (8, "")]


def test_against_brute_force(documents, rows):
    check(documents(rows), rows, 5, block_bytes=16384, range_windows=50)


def test_blocks_are_bounded_and_in_order(documents, rows):
    blocks, n = blocks_of_rows(documents(rows).select("doc_id", "text"), 16384)
    found = blocks.groupBy("block").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("own"))
    found = sorted(found.collect(), key=lambda r: r.block)
    assert sum(r.rows for r in found) == len(rows) and 0 <= found[0].block and found[-1].block < n
    assert max(r.rows for r in found) <= 12  # a row weighs 4,096 bytes
    order = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())
    for a, b in zip(found, found[1:]):
        assert max(map(order, a.own)) <= min(map(order, b.own))
