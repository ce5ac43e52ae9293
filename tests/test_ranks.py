"""Queries that factorize above rank 1, on the smallest tables."""

import os
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver
from cohortvec.operators import factorization as N

FOLDER = driver.SMOKE_FOLDER
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize(("name", "ranks"), [("nmf_embeddings_rank6", {6}), ("train_embeddings_ranks", {4, 8}), ("train_embeddings_cooc_rank6", {6})])
def test_every_item_has_a_vector_of_the_rank(spark, name, ranks):
    vectors = defaultdict(dict)
    for r in driver.queries()[name](spark, FOLDER).collect():
        vectors[r["item"]][r["dimension"]] = r["value"]
    assert len(vectors) == 25
    (rank,) = {len(v) for v in vectors.values()}
    assert rank in ranks
    assert all(sorted(v) == list(range(rank)) and min(v.values()) >= 0 for v in vectors.values())
    used = {d for v in vectors.values() for d, x in v.items() if x > 0}
    assert len(used) > 1 and all(max(v.values()) > 0 for v in vectors.values())


@pytest.fixture(scope="module")
def brand_matrix():
    """Line counts per person and brand, both by name, read without Spark."""
    tables = {t: pq.read_table(f"{FOLDER}/{t}.parquet").to_pandas() for t in ("orders", "lineitem", "part")}
    lines = tables["orders"].merge(tables["lineitem"], left_on="o_orderkey", right_on="l_orderkey")
    lines = lines.merge(tables["part"], left_on="l_partkey", right_on="p_partkey")
    return lines.groupby(["o_custkey", "p_brand"]).size().unstack(fill_value=0).sort_index().sort_index(axis=1)


def fitted(matrix, rank, alpha, rounds, tol=1e-4):
    """The rounds of a fit in numpy, from the same random start."""
    x = matrix.to_numpy(np.float64)
    h = N.start_vectors(np.arange(x.shape[1]), rank, float(np.sqrt(x.mean() / rank)), 42)
    losses = []
    for step in range(rounds + 1):
        w = N.solve_rows(x @ h, h.T @ h + alpha * x.shape[1] * np.eye(rank))
        ridge = 0.5 * alpha * (x.shape[1] * (w**2).sum() + len(x) * (h**2).sum())
        losses.append(0.5 * ((x - w @ h.T) ** 2).sum() + ridge)
        if step == rounds or (step and losses[-2] - losses[-1] <= tol * losses[-2]):
            return h
        h = N.solve_rows(x.T @ w, w.T @ w + alpha * len(x) * np.eye(rank))


def vectors_of(rows, rank):
    out = {}
    for r in rows:
        out.setdefault(r["item"], np.zeros(rank))[r["dimension"]] = r["value"]
    return np.array([out[i] for i in sorted(out)])


def test_rank6_vectors_equal_numpy(spark, brand_matrix):
    got = vectors_of(driver.queries()["nmf_embeddings_rank6"](spark, FOLDER).collect(), 6)
    assert np.allclose(got, fitted(brand_matrix, 6, 0.0, 30), rtol=1e-3, atol=1e-3)


def test_cosine_ranks_equal_numpy(spark, brand_matrix):
    h = fitted(brand_matrix, 6, 0.0, 20)
    unit = h / np.linalg.norm(h, axis=1, keepdims=True)
    names = list(brand_matrix.columns)
    scores = pd.DataFrame(unit @ unit.T, names, names)
    ranks = scores.round(9).rank(method="min", ascending=False)
    rows = driver.queries()["nmf_ranked_list_cosine"](spark, FOLDER).toPandas().set_index("feature_name").loc[names]
    assert len(rows) == 25 and np.allclose(rows["mean_score"], scores.mean(axis=1), atol=1e-3)
    for name in names:
        assert np.allclose(rows[f"{name}_score"], scores[name], atol=2e-3)
        assert rows.loc[name, f"{name}_rank"] == 1
    assert np.corrcoef(rows["mean_rank"], ranks.mean(axis=1))[0, 1] > 0.99


def test_rank50_vectors_equal_numpy(spark):
    tables = {t: pq.read_table(f"{FOLDER}/{t}.parquet").to_pandas() for t in ("orders", "lineitem")}
    lines = tables["orders"].merge(tables["lineitem"], left_on="o_orderkey", right_on="l_orderkey")
    lines["feature"] = "P" + lines["l_partkey"].astype(str)
    matrix = lines.groupby(["o_custkey", "feature"]).size().unstack(fill_value=0).sort_index().sort_index(axis=1)
    got = vectors_of(driver.queries()["nmf_embeddings_rank50"](spark, FOLDER).collect(), 50)
    assert np.allclose(got, fitted(matrix, 50, 0.05, 2), rtol=1e-3, atol=1e-3)


def test_grid_takes_the_settings_of_single_fits(spark, brand_matrix):
    rows = driver.queries()["nmf_grid_search_ranks"](spark, FOLDER).collect()
    assert [(r.embedding_size, r.regularization, r.max_iterations) for r in rows] == [(4, 0.0, 10), (4, 0.001, 10), (8, 0.0, 10), (8, 0.001, 10)]
    assert all(0 < r.score < 1 for r in rows) and len({r.score for r in rows}) == 4
