import random

import numpy as np
import pyarrow as pa
import pytest

from cohortvec.operators import components, indexing
from cohortvec.operators.components import connected_groups

from .test_curation import PAIRS, groups_of, union_find


@pytest.fixture
def many_pieces(spark):
    """Pairs stay in eight pieces, as those of a large table do."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture
def stored(monkeypatch):
    """What connected_groups writes: label and rows of each table."""
    tables = []

    def store(df, label, store=components.store):
        table = store(df, label)
        tables.append((label, table.df.count()))
        return table

    monkeypatch.setattr(components, "store", store)
    return tables


def test_pairs_of_one_piece_take_one_round(table, stored):
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)]
    got = connected_groups(table([(i, a, b) for i, (a, b) in enumerate(chain)], PAIRS))
    assert {r.group for r in got.collect()} == {"0000"}
    assert len(stored) == 1


def test_rounds_take_fewer_and_fewer_pairs(table, many_pieces, stored):
    links = [(f"{i:05d}", f"{i + 1:05d}") for i in range(600)]
    got = connected_groups(table([(i, a, b) for i, (a, b) in enumerate(links)], PAIRS))
    assert {(r.node, r.group) for r in got.collect()} == {(f"{i:05d}", "00000") for i in range(601)}
    rounds = [n for label, n in stored if label == "stars"]
    assert len(rounds) > 2 and sum(rounds) < 3 * len(links)


@pytest.mark.parametrize("piece_rows", [3, 10**6])
def test_many_pieces_equal_union_find(table, many_pieces, monkeypatch, piece_rows):
    monkeypatch.setattr(indexing, "PIECE_ROWS", piece_rows)
    rng = random.Random(2)
    pairs = [("hub", f"n{i}") for i in range(60)] + [("x", "x"), ("n1", "n1"), ("é", "z"), ("a", "b"), ("b", "a")]
    pairs += [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(0, None, "q"), (1, "hub", None)]
    got = connected_groups(table(rows, PAIRS)).collect()
    assert groups_of(table([(r.node, r.group) for r in got], "node string, group string")) == union_find(pairs)
    assert len({r.node for r in got}) == len(got)
    assert all(r.group == min(s.node for s in got if s.group == r.group) for r in got)


@pytest.mark.parametrize("kind", ["bigint", "date", "binary"])
def test_kinds_of_codes(spark, many_pieces, kind):
    pairs = spark.range(40).selectExpr("id * 2 - 30 AS a", "id * 2 - 28 AS b").where("a <> 12")
    as_kind = {"bigint": "{}", "date": "date_add(DATE '2000-01-01', CAST({} AS INT))", "binary": "CAST(concat('c', {}) AS BINARY)"}[kind]
    got = connected_groups(pairs.selectExpr(*[f"{as_kind.format(c)} AS CUI{k}" for k, c in ((1, "a"), (2, "b"))])).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group, []).append(r.node)
    assert all(k == min(v) for k, v in groups.items()) and sorted(map(len, groups.values())) == [19, 22]


def test_pieces_join_what_they_hold():
    batches = [pa.RecordBatch.from_pydict({"u": ["c", "e"], "v": ["b", "d"]}), pa.RecordBatch.from_pydict({"u": ["b"], "v": ["a"]})]
    u, v = components._joined(batches)
    assert sorted(zip(u.to_pylist(), v.to_pylist())) == [("b", "a"), ("c", "a"), ("e", "d")]
    assert components._smallest_linked(np.array([4, 2, 3]), np.array([3, 1, 2]), 6).tolist() == [0, 1, 1, 1, 1, 5]
