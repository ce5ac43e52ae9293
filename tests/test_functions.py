import pytest
from pyspark.sql import functions as F

from cohortvec.functions.codes import clean_code, expand_code_ranges, matches_disease
from cohortvec.functions.hashing import hash_fraction
from cohortvec.functions.text import matches_any
from cohortvec.functions.vectors import cosine_similarity, euclidean_similarity

from .conftest import as_set


def one(df):
    return [r[0] for r in df.collect()]


def test_clean_code(table):
    df = table([("C7A.02",), (None,)], "c string")
    assert one(df.select(clean_code(F.col("c")))) == ["c7a02", None]


def test_disease_match_is_containment(table):
    df = table([("C1.0",), ("AC1X",), ("c20",), (None,)], "c string")
    assert one(df.select(matches_disease(F.col("c"), ["C1"]))) == [True, True, False, False]
    assert one(df.select(matches_disease(F.col("c"), ["C.1"], "prefix"))) == [True, False, False, False]
    assert one(df.select(matches_disease(F.col("c"), []))) == [False] * 4


@pytest.mark.parametrize(
    "code, correct, legacy",
    [
        ("c15-c17", ["c15", "c16", "c17"], ["c15", "c16", "c17"]),
        ("d00-d09", [f"d0{i}" for i in range(10)], [f"d0{i}" for i in range(10)]),
        ("c00-c14", [f"c{i:02d}" for i in range(15)], [f"c0{i}" for i in range(5)]),
        ("a05-a12", [f"a{i:02d}" for i in range(5, 13)], []),
        ("c50", ["c50"], ["c50"]),
    ],
)
def test_code_ranges(table, code, correct, legacy):
    df = table([(1, code)], "id long, c string")
    assert [r.c for r in expand_code_ranges(df, "c").collect()] == correct
    assert [r.c for r in expand_code_ranges(df, "c", legacy=True).collect()] == legacy


@pytest.mark.parametrize(
    "code, ends", [("c7a-c7b", ["c7a", "c7b"]), ("c99-d05", ["c99", "d05"]), ("c9-c05", ["c9", "c05"])]
)
def test_bounds_that_do_not_count_give_both_ends(table, code, ends):
    df = table([(code,)], "c string")
    assert [r.c for r in expand_code_ranges(df, "c").collect()] == ends


def test_null_code_stays(table):
    assert as_set(expand_code_ranges(table([(1, None)], "id long, c string"), "c")) == [(1, None)]


def test_regex_filter(table):
    df = table([("abc",), ("cd",), ("bac",), ("c",)], "t string")
    keep = lambda *a, **k: one(df.filter(matches_any(F.col("t"), *a, **k)))
    assert keep(["a", "c."]) == ["abc", "cd"]
    assert keep(None) == ["abc", "cd", "bac", "c"]
    assert keep([]) == []
    assert keep(["a|b"]) == ["abc", "bac"]
    assert keep(["c."], literal=True) == []


def test_hash_fraction_is_uniform_and_stable(spark):
    df = spark.range(5000).select(hash_fraction(F.col("id"), 42).alias("h"))
    share = df.filter("h < 0.9").count() / 5000
    assert 0.88 < share < 0.92
    assert df.repartition(3).filter("h < 0.9").count() == df.filter("h < 0.9").count()
    assert df.filter("h < 0 or h >= 1").isEmpty()


def test_vector_similarities(table):
    df = table([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(cosine_similarity(F.col("a"), F.col("b")), euclidean_similarity(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(0.5**0.5)
    assert got[0][1] == pytest.approx(0.5)
    assert got[1][0] == 0.0


def test_long_numbers_and_long_ranges_count(table):
    rows = [(1, "c1000000000-c1000000002"), (2, "c7-c31"), (3, None), (4, "d" + "9" * 37 + "8-d" + "9" * 38), (5, "x1-y2")]
    df = table(rows, "id long, c string")
    want = [(1, f"c{1000000000 + i}") for i in range(3)] + [(2, f"c{i}") for i in range(7, 32)]
    want += [(3, None), (4, "d" + "9" * 37 + "8"), (4, "d" + "9" * 38), (5, "x1"), (5, "y2")]
    for step in (10, 1_000_000):
        assert sorted(map(repr, (tuple(r) for r in expand_code_ranges(df, "c", range_step=step).collect()))) == sorted(map(repr, want))
