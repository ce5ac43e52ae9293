from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortvec.operators import cooccurrence as cooc
from cohortvec.operators.indexing import attach_index, build_key_index, dense_index
from cohortvec.operators.pairing import pair_up, pairs_within
from cohortvec.operators.ratings import (
    cohort_sample,
    dense_ratings,
    full_narrow_master,
    sparse_ratings,
    split_by_person,
    sum_duplicates,
)

from .conftest import as_set

LOG = "person_id long, feature_name string"
EVENTS = [(1, "x"), (1, "x"), (1, "y"), (2, "y"), (7, "z")]


@pytest.fixture(scope="module")
def log(table):
    return table(EVENTS, LOG)


def test_index_is_dense_and_sorted(spark, table):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = as_set(dense_index(df, "k", "i"))
    assert got == [(k, k) for k in range(1000)]
    names = table([("b",), ("a",), ("b",), (None,)], "k string")
    assert {r.k: r.i for r in dense_index(names, "k", "i").collect()} == {None: 0, "a": 1, "b": 2}


def test_index_of_nothing(table):
    assert dense_index(table([], "k string"), "k", "i").count() == 0


def test_hot_keys_are_cut_and_the_join_stays_whole(spark):
    hot = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("other"))
    rest = spark.range(8000).select(F.concat(F.lit("k"), F.col("id") % 2000).alias("k"), F.col("id").alias("other"))
    facts = hot.unionByName(rest)
    index = build_key_index(facts, "k", "i")
    salted = attach_index(facts, index, ["other"], broadcast_bytes=0)
    assert as_set(salted.select("k", "other", "i")) == as_set(attach_index(facts, index, ["other"]).select("k", "other", "i"))
    assert salted.count() == 12000


def test_sparse_ratings(log):
    rows = sparse_ratings(log)
    assert as_set(rows.ratings) == [(0, 0, 1), (0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 1)]
    assert as_set(rows.persons) == [(1, 0), (2, 1), (7, 2)]
    assert as_set(rows.features) == [("x", 0), ("y", 1), ("z", 2)]
    summed = [(0, 0, 2), (0, 1, 1), (1, 1, 1), (2, 2, 1)]
    assert as_set(sparse_ratings(log, "sum").ratings) == summed
    assert as_set(sum_duplicates(rows.ratings)) == summed
    assert as_set(sparse_ratings(log, "dedupe").ratings) == [(u, i, 1) for u, i, _ in summed]
    with pytest.raises(ValueError):
        sparse_ratings(log, "other")


def test_repeated_event_expands_in_steps(table):
    log = table([(1, "x")] * 25 + [(2, "x")] * 3 + [(2, "y")] * 10, LOG)
    got = Counter(as_set(sparse_ratings(log, repeat_block=10).ratings))
    assert got == {(0, 0, 1): 25, (1, 0, 1): 3, (1, 1, 1): 10}


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_complete_grid(log, block):
    grid = {(p, f): 0 for p in (1, 2, 7) for f in "xyz"} | {(1, "x"): 2, (1, "y"): 1, (2, "y"): 1, (7, "z"): 1}
    assert as_set(full_narrow_master(log, block_size=block)) == sorted((p, f, n) for (p, f), n in grid.items())
    number = {1: 0, 2: 1, 7: 2, "x": 0, "y": 1, "z": 2}
    want = sorted((number[p], number[f], n) for (p, f), n in grid.items())
    assert as_set(dense_ratings(log, block_size=block).ratings) == want
    binary = full_narrow_master(log, binary=True, block_size=block)
    assert binary.agg(F.max("active")).first()[0] == 1


def test_split_by_person(spark):
    log = spark.range(2000).select((F.col("id") % 200).alias("person_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("feature_name"))
    indexed = sparse_ratings(log, "sum")
    train, test = split_by_person(indexed.ratings, indexed.persons, 0.9)
    users = [sorted(r[0] for r in side.select("user").distinct().collect()) for side in (train, test)]
    assert len(users[0]) + len(users[1]) == 200 and 165 < len(users[0]) < 195
    assert users[0] == list(range(len(users[0]))) and users[1] == list(range(len(users[1])))
    assert train.count() + test.count() == indexed.ratings.count()
    again = split_by_person(indexed.ratings.repartition(3), indexed.persons.repartition(5), 0.9)
    assert as_set(again.train) == as_set(train)
    everything = split_by_person(indexed.ratings, indexed.persons, 1.0)
    assert everything.test.isEmpty() and everything.train.count() == indexed.ratings.count()


def test_cohort_sample_keeps_whole_persons(spark):
    log = spark.range(30000).select((F.col("id") % 3000).alias("person_id"), F.lit("f").alias("feature_name"))
    sample = cohort_sample(log, 0.1)
    per_person = sample.groupBy("person_id").count().collect()
    assert {r["count"] for r in per_person} == {10}
    assert 230 < len(per_person) < 370
    assert as_set(cohort_sample(log.repartition(5), 0.1)) == as_set(sample)


def naive_cooccurrence(events):
    counts = Counter(events)
    people = {p for p, _ in events}
    out = Counter()
    for p in people:
        mine = {f: n for (q, f), n in counts.items() if q == p}
        for a in mine:
            for b in mine:
                out[(a, b)] += mine[a] * mine[b]
    return sorted((a, b, n) for (a, b), n in out.items())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abcdef")), min_size=1, max_size=40), st.sampled_from([(1, 0), (3, 0), (4096, 0), (4096, 4096)]))
def test_cooccurrence_equals_counting(table, events, limits):
    got = cooc.cooccurrence(table(events, LOG), tile_rows=limits[0], array_items=limits[1])
    assert as_set(got) == naive_cooccurrence(events)


def test_both_ways_to_count_pairs_agree(spark):
    log = spark.range(3000).select(
        (F.col("id") % 40).alias("person_id"), F.concat(F.lit("f"), F.xxhash64("id") % 60).alias("feature_name")
    )
    joined = as_set(cooc.cooccurrence(log, array_items=0))
    assert as_set(cooc.cooccurrence(log)) == joined
    assert as_set(cooc.cooccurrence(log, pairs_at_once=50)) == joined


def test_cooccurrence_forms(log):
    pairs = cooc.cooccurrence(log)
    assert as_set(pairs) == [("x", "x", 4), ("x", "y", 2), ("y", "x", 2), ("y", "y", 2), ("z", "z", 1)]
    wide = cooc.cooccurrence_wide(pairs)
    assert wide.columns == ["feature_name", "x", "y", "z"]
    assert as_set(wide) == [("x", 4, 2, 0), ("y", 2, 2, 0), ("z", 0, 0, 1)]
    ratings = cooc.cooccurrence_ratings(pairs)
    assert as_set(ratings.ratings) == [(0, 0, 4), (0, 1, 2), (1, 0, 2), (1, 1, 2), (2, 2, 1)]
    assert as_set(ratings.persons) == [("x", 0), ("y", 1), ("z", 2)]


@pytest.mark.parametrize("tile_rows", [3, 4096])
def test_large_groups_are_tiled_without_loss(spark, tile_rows):
    rows = [(0, i) for i in range(20)] + [(1, i) for i in range(2)]
    df = spark.createDataFrame(rows, "g long, i long")
    want = sorted((g, a, b) for g, a in rows for h, b in rows if g == h and a <= b)
    assert as_set(pairs_within(df, "g", "i", tile_rows)) == want
    right = df.select("g", F.col("i").alias("j"))
    got = pair_up(df, right, "g", "i", "j", tile_rows=tile_rows).select("g", "i", "j")
    assert as_set(got) == sorted((g, a, b) for g, a in rows for h, b in rows if g == h)
