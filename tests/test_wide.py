"""Wide tables against a pivot, and beyond what a pivot takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortvec.operators import similarity as S
from cohortvec.operators import wide
from cohortvec.operators.wide import wide_table


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_like_a_pivot(spark, monkeypatch, block):
    monkeypatch.setattr(wide, "BLOCK_CELLS", block)
    rng = np.random.default_rng(1)
    cells = {(f"k{i}", f"n.{j} x") for i, j in rng.integers(0, 20, (150, 2)).tolist()}
    rows = [(k, n, float(len(k + n)) if i % 5 else None, i) for i, (k, n) in enumerate(sorted(cells))]
    long = spark.createDataFrame(rows, "k string, name string, s double, r bigint")
    got = wide_table(long, "k", "name", ["s", "r"]).toPandas().set_index("k").sort_index()
    want = long.groupBy("k").pivot("name").agg(F.first("s").alias("s"), F.first("r").alias("r")).toPandas().set_index("k").sort_index()
    assert list(got.columns) == list(want.columns) and got.equals(want)
    counts = wide_table(long, "k", "name", ["r"], fill=-1).toPandas().set_index("k").sort_index()
    assert counts.dtypes.eq("int64").all() and (counts == want.filter(like="_r").fillna(-1).to_numpy()).all().all()


def test_empty(spark):
    long = spark.createDataFrame([], "k string, name string, s double")
    assert wide_table(long, "k", "name", ["s"]).collect() == []


def test_20000_referentials(spark):
    """Twice the columns that Spark's pivot allows at most."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(rng.normal(size=(6, 4)).tolist())], "feature_name string, embedding array<double>")
    members = spark.range(20_000).select(
        F.concat(F.lit("ref"), F.col("id")).alias("referential_name"), F.concat(F.lit("f"), F.col("id") % 6).alias("feature_name")
    )
    listed = S.ranked_list(vectors, members, ["ref"], top_k=1)
    assert len(listed.columns) == 1 + 2 * 20_000 + 5
    own = listed.select("feature_name", "ref6_rank", "ref7_rank", "ref19999_score", "number_in_top_1").collect()
    assert {r.feature_name: r.number_in_top_1 for r in own} == {f"f{i}": 3334 if i < 2 else 3333 for i in range(6)}
    by_name = {r.feature_name: r for r in own}
    assert by_name["f0"].ref6_rank == by_name["f1"].ref7_rank == 1
    assert by_name["f1"].ref19999_score == pytest.approx(1.0)
