import os

import numpy as np
import pytest

from cohortvec.operators import factorization as N
from cohortvec.plans.training import save_training, train_cooccurrence_embeddings, train_embeddings
from cohortvec.session import discard_stored, scratch, shared_folder, store
from cohortvec.sources.events import synthetic_events

CELLS = "user long, item long, rating double"


def cells_of(spark, matrix):
    rows = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(rows, CELLS)


def matrix_of(df, key, rows):
    out = {r[key]: r.embedding for r in df.collect()}
    return np.array([out[i] for i in range(rows)])


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(0)
    matrix = (rng.random((60, 30)) < 0.3) * rng.integers(1, 4, (60, 30))
    return matrix, N.RatingCells(cells_of(spark, matrix), 30)


def test_solver_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    a = rng.random((12, 5))
    b = rng.standard_normal((200, 12)) @ a
    w = N.solve_rows(b, a.T @ a)
    gradient = w @ (a.T @ a) - b
    assert (w >= 0).all()
    assert np.abs(gradient[w > 0]).max() < 1e-3 and gradient[w == 0].min() > -1e-3


@pytest.mark.parametrize("alpha", [0.0, 0.01])
def test_loss_falls_and_is_the_loss(counts, alpha):
    matrix, data = counts
    model = N.fit(data, 4, alpha, 15)
    assert all(a >= b - 1e-6 for a, b in zip(model.losses, model.losses[1:]))
    h = matrix_of(model.items, "item", 30)
    w = matrix_of(N.fold_in(data, model.items, alpha), "user", 60)
    assert (h >= 0).all() and (w >= 0).all()
    loss = 0.5 * ((matrix - w @ h.T) ** 2).sum() + 0.5 * alpha * (30 * (w**2).sum() + 60 * (h**2).sum())
    assert model.losses[-1] == pytest.approx(loss, rel=1e-6)
    again = N.fit(data, 4, alpha, 15)
    assert np.allclose(h, matrix_of(again.items, "item", 30))


def test_joined_way_computes_the_same(counts):
    _, data = counts
    small, large = N.fit(data, 3, 0.01, 2, tol=0), N.fit(data, 3, 0.01, 2, tol=0, model_bytes=0)
    assert small.losses == pytest.approx(large.losses, rel=1e-6)
    assert np.allclose(matrix_of(small.items, "item", 30), matrix_of(large.items, "item", 30), atol=1e-5)
    ways = [N.fold_in(data, small.items, 0.01, model_bytes=b) for b in (0, N.MODEL_BYTES)]
    assert np.allclose(*(matrix_of(w, "user", 60) for w in ways), atol=1e-5)


def test_planted_blocks_are_found(spark):
    matrix = np.zeros((40, 10))
    matrix[:20, :5] = 1
    matrix[20:, 5:] = 1
    h = matrix_of(N.fit(N.RatingCells(cells_of(spark, matrix), 10), 2, 0.0, 50).items, "item", 10)
    unit = h / np.linalg.norm(h, axis=1, keepdims=True)
    sims = unit @ unit.T
    assert sims[:5, :5].min() > 0.99 and sims[5:, 5:].min() > 0.99 and sims[:5, 5:].max() < 0.05


@pytest.mark.parametrize("legacy", [False, True])
def test_metrics_equal_the_dense_ones(spark, counts, legacy):
    matrix, data = counts
    rng = np.random.default_rng(2)
    w, h = rng.random((60, 3)), rng.random((30, 3))
    h[4] = 0
    frame = lambda key, m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{key} long, embedding array<double>")
    got = {r.metric: r.value for r in N.factor_metrics(data.cells, frame("user", w), frame("item", h), legacy_inactive=legacy).collect()}
    error = matrix - w @ h.T
    active, inactive = matrix != 0, (matrix != 1) if legacy else (matrix == 0)
    norms = np.linalg.norm(h, axis=1, keepdims=True)
    unit = np.divide(h, norms, out=np.zeros_like(h), where=norms > 0)
    want = (
        np.abs(error).mean(),
        np.abs(error[active]).mean(),
        np.abs(error[inactive]).mean(),
        (error**2).mean(),
        (error[active] ** 2).mean(),
        (error[inactive] ** 2).mean(),
        active.sum(),
        inactive.sum(),
        np.var(unit @ unit.T),
    )
    assert [got[m] for m in N.METRICS] == pytest.approx(list(want))


@pytest.mark.parametrize("legacy", [False, True])
def test_metrics_in_one_pass_are_the_joined_ones(counts, legacy):
    _, data = counts
    items = N.fit(data, 3, 0.01, 2).items
    users = N.fold_in(data, items, 0.01)
    joined = N.factor_metrics(data.cells, users, items, legacy_inactive=legacy).collect()
    for size in (0, N.MODEL_BYTES):
        passed = N.fold_in_metrics(data, items, 0.01, legacy_inactive=legacy, model_bytes=size).collect()
        assert [r.metric for r in passed] == [r.metric for r in joined]
        assert [r.value for r in passed] == pytest.approx([r.value for r in joined])


def test_rows_are_solved_alone(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.random((9, 4))
    b = rng.standard_normal((70, 9)) @ a
    together = N.solve_rows(b, a.T @ a)
    assert (together == np.vstack([N.solve_rows(row[None], a.T @ a) for row in b])).all()
    assert N.solve_rows_counted(b, a.T @ a)[1] == 0
    monkeypatch.setattr(N, "SWEEPS", 1)
    assert 0 < N.solve_rows_counted(b, a.T @ a)[1] <= 70


def test_items_solved_on_executors(counts, monkeypatch):
    _, data = counts
    here = matrix_of(N.fit(data, 3, 0.01, 3).items, "item", 30)
    monkeypatch.setattr(N, "DRIVER_SOLVE", 0)
    assert np.allclose(here, matrix_of(N.fit(data, 3, 0.01, 3).items, "item", 30))


def test_given_start_and_both_ways(counts):
    from pyspark.sql import functions as F

    _, data = counts
    start = lambda item: F.array(1 / (1 + item % 6), 1 / (2 + item % 4))
    ways = [N.fit(data, 2, 0.01, 4, tol=-1, model_bytes=b, start=start) for b in (0, N.MODEL_BYTES)]
    assert ways[0].losses == pytest.approx(ways[1].losses, rel=1e-9)


def test_scores(spark):
    metrics = spark.createDataFrame([("MSE", 0.25, "test"), ("similarity_variance", 0.1, "test")], N.METRIC_SCHEMA)
    assert N.performance_score(metrics) == pytest.approx(0.8)
    assert N.performance_score(metrics, "similarity_variance") == pytest.approx(0.1)
    assert N.performance_score(metrics.limit(0)) == 0
    with pytest.raises(ValueError):
        N.performance_score(metrics, "other")


def test_empty_data(spark):
    empty = spark.createDataFrame([], CELLS)
    with pytest.raises(ValueError):
        N.fit(N.RatingCells(empty, 3), 2)
    vectors = spark.createDataFrame([], "user long, embedding array<double>")
    items = vectors.withColumnRenamed("user", "item")
    assert N.factor_metrics(empty, vectors, items).isEmpty()


@pytest.mark.parametrize("model_bytes", [0, N.MODEL_BYTES])
def test_grid_search_takes_the_best(spark, counts, model_bytes):
    matrix, _ = counts
    train, test = cells_of(spark, matrix[:50]), cells_of(spark, matrix[50:])
    found = N.grid_search(train, test, 30, [2, 4], [0.0], [2], workers=2, model_bytes=model_bytes)
    scores = {r.embedding_size: r.score for r in found.scores.collect()}
    assert found.best == (max(scores, key=scores.get), 0.0, 2)
    assert {r.metric for r in found.metrics.collect()} == set(N.METRICS)
    assert found.items.count() == 30


def test_training_and_saving(spark, tmp_path):
    log = synthetic_events(spark, [f"event {i}" for i in range(8)], persons=60, events_per_person=10)
    trained = train_embeddings(log, (3,), (0.0,), (3,))
    assert trained.embeddings.count() == 8 and trained.features.count() == 8
    save_training(trained, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv" / "embeddings")).columns == [
        "item",
        "feature_name",
        "emb_vec_0",
        "emb_vec_1",
        "emb_vec_2",
    ]
    save_training(trained, str(tmp_path / "parquet"))
    assert spark.read.json(str(tmp_path / "parquet" / "metrics")).count() == 9
    with pytest.raises(Exception, match="(?i)exists"):
        save_training(trained, str(tmp_path / "parquet"))
    cooc = train_cooccurrence_embeddings(log, (2,), (0.0,), (3,), ratio=0.5)
    assert cooc.embeddings.count() == 8


def test_synthetic_events(spark):
    log = synthetic_events(spark, ["a", "b", "c"], persons=100, events_per_person=20)
    assert log.count() == 2000
    assert {r[0] for r in log.select("feature_name").distinct().collect()} == {"a", "b", "c"}
    assert log.filter("person_id < 0 or person_id >= 100").isEmpty()
    assert sorted(log.collect()) == sorted(synthetic_events(spark, ["a", "b", "c"], 100, 20).repartition(3).collect())


def stored_files(spark):
    root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    return {f"{d}/{f}" for d, _, names in os.walk(root) for f in names}


def test_scopes_remove_their_tables(spark):
    before = stored_files(spark)
    with scratch(spark) as outer:
        five = store(spark.range(5), "five").df
        with scratch(spark):
            assert store(five, "inner").df.count() == 5
        kept = outer.keep(five, "kept")
        assert five.count() == 5
    assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(five.inputFiles()[0]).count()
    assert {p.split("/kept")[0] for p in stored_files(spark) - before} == {p.split("/kept")[0] for p in kept_files(spark)}


def kept_files(spark):
    return {p for p in stored_files(spark) if "/kept-" in p}


def test_training_leaves_nothing_in_a_scope(spark):
    log = synthetic_events(spark, [f"event {i}" for i in range(8)], persons=60, events_per_person=10)
    before = stored_files(spark)
    with scratch(spark):
        trained = train_embeddings(log, (2,), (0.0,), (2,))
        assert trained.embeddings.count() == 8
        inside = {p.split("/kept-")[0] for p in stored_files(spark) - before if p.endswith(".parquet")}
        assert len(inside) == 1  # embeddings and features only
    assert stored_files(spark) == before


def test_stored_tables_use_the_configured_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = store(spark.range(5), "five")
    assert kept.path.startswith(shared_folder(spark)) and kept.df.count() == 5
    kept.discard()
    with pytest.raises(Exception):
        spark.read.parquet(kept.path).count()
    discard_stored(spark)


def test_rows_settle_as_in_plain_loops():
    """Every row alone, component by component in their order, gives the same bits."""
    rng = np.random.default_rng(2)
    for rank in (1, 3, 8, 12):
        a = rng.random((30, rank))
        gram, b = a.T @ a, rng.normal(size=(40, 30)) @ a
        gram[0], gram[:, 0] = (0.0, 0.0) if rank == 3 else (gram[0], gram[:, 0])
        inverse = np.linalg.pinv(gram, hermitian=True)
        want, still = [], 0
        for row in b:
            own = [max(sum((inverse[j, i] * row[i] for i in range(rank)), 0.0), 0.0) for j in range(rank)]
            for _ in range(N.SWEEPS):
                scale, change = max(*own, 1e-30), 0.0
                for j in range(rank):
                    if gram[j, j] <= 0.0:
                        own[j] = 0.0
                        continue
                    total = gram[j, 0] * own[0]
                    for i in range(1, rank):
                        total += gram[j, i] * own[i]
                    moved = max((row[j] - total) / gram[j, j] + own[j], 0.0)
                    change, own[j] = max(change, abs(moved - own[j])), moved
                if change <= N.SWEEP_TOLERANCE * scale:
                    break
            else:
                still += 1
            want.append(own)
        got, unsettled = N.solve_rows_counted(b, gram)
        assert (got == np.array(want)).all() and unsettled == still
