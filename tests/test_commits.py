"""Outputs that are read only when whole, and fits that go on after a stop."""

import os

import numpy as np
import pytest

from cohortvec.operators import factorization as N
from cohortvec.operators.rounds import RoundStates
from cohortvec.plans import training
from cohortvec.sources import sinks
from cohortvec.sources.commits import NotCommitted, children, manifest, staged
from cohortvec.sources.events import synthetic_events

from .conftest import as_set
from .test_factorization import cells_of, matrix_of


class Stop(Exception):
    pass


def test_parts_and_manifest(spark, tmp_path):
    folder = str(tmp_path / "out")
    with staged(spark, folder, {"n": 3}) as parts:
        spark.range(3).write.parquet(parts.path("a"))
        spark.range(4).write.parquet(parts.path("b"))
        assert [c for c in children(spark, folder) if not c.startswith("_")] == []
    assert children(spark, folder) == ["a", "b", "manifest.json"]
    assert manifest(spark, folder) == {"parts": ["a", "b"], "about": {"n": 3}}
    assert spark.read.parquet(f"{folder}/b").count() == 4
    with pytest.raises(FileExistsError, match="already exists"), staged(spark, folder):
        pass


def test_an_error_inside_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(Stop), staged(spark, folder) as parts:
        spark.range(3).write.parquet(parts.path("a"))
        raise Stop
    assert children(spark, folder) == []
    with pytest.raises(NotCommitted):
        manifest(spark, folder)
    with pytest.raises(NotCommitted):
        manifest(spark, str(tmp_path / "nowhere"))


@pytest.fixture(scope="module")
def trained(spark):
    log = synthetic_events(spark, [f"event {i}" for i in range(8)], persons=60, events_per_person=10)
    return training.train_embeddings(log, (3,), (0.0,), (3,))


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_training_comes_back(spark, trained, tmp_path, file_format):
    folder = str(tmp_path / "model")
    training.save_training(trained, folder, file_format)
    back = training.read_training(spark, folder)
    for name in training.Trained._fields:
        assert getattr(back, name).columns == getattr(trained, name).columns
        assert as_set(getattr(back, name)) == as_set(getattr(trained, name))


@pytest.mark.parametrize("write", ["write_index", "write_metrics"])
def test_a_stop_between_two_writes(spark, trained, tmp_path, monkeypatch, write):
    def stopped(*args):
        raise Stop

    folder = str(tmp_path / "model")
    with monkeypatch.context() as m:
        m.setattr(sinks, write, stopped)
        # as when the process ends: nothing is cleaned up either
        m.setattr("cohortvec.sources.commits.remove", lambda *a: None)
        with pytest.raises(Stop):
            training.save_training(trained, folder)
    assert children(spark, folder) != []
    with pytest.raises(NotCommitted):
        training.read_training(spark, folder)
    training.save_training(trained, folder)  # what was left is no obstacle
    assert training.read_training(spark, folder).embeddings.count() == 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    matrix = (rng.random((60, 30)) < 0.3) * rng.integers(1, 4, (60, 30))
    return N.RatingCells(cells_of(spark, matrix), 30)


SETTINGS = [N.Setting(3, 0.0, 6), N.Setting(2, 0.01, 6), N.Setting(3, 0.0, 2)]


@pytest.mark.parametrize("model_bytes", [N.MODEL_BYTES, 0])
@pytest.mark.parametrize("stop", [1, 5])
def test_a_stopped_fit_goes_on(spark, data, tmp_path, monkeypatch, model_bytes, stop):
    settings = SETTINGS if model_bytes else SETTINGS[:1]
    whole = N.fit_settings(data, settings, tol=-1, model_bytes=model_bytes)
    state, saves = str(tmp_path / "state"), []
    plain = RoundStates.save

    def counted(self, step, noted, table):
        if len(saves) == stop:
            raise Stop
        saves.append(step)
        return plain(self, step, noted, table)

    with monkeypatch.context() as m:
        m.setattr(RoundStates, "save", counted)
        with pytest.raises(Stop):
            N.fit_settings(data, settings, tol=-1, model_bytes=model_bytes, state=state)
    assert saves == list(range(1, stop + 1))
    (name,) = os.listdir(state)
    assert len(children(spark, f"{state}/{name}")) == min(stop, 2)  # older states go
    steps = []
    monkeypatch.setattr(N, "_report", lambda unsettled, step: steps.append(step))
    rest = N.fit_settings(data, settings, tol=-1, model_bytes=model_bytes, state=state)
    assert min(steps) == stop
    for a, b in zip(whole, rest, strict=True):
        assert a.losses == pytest.approx(b.losses, rel=1e-12)
        assert np.allclose(matrix_of(a.items, "item", 30), matrix_of(b.items, "item", 30), atol=1e-9)


def test_half_a_state_and_another_fit(spark, data, tmp_path):
    state = str(tmp_path / "state")
    N.fit(data, 3, 0.0, 2, tol=-1, state=state)
    (name,) = os.listdir(state)
    folder = f"{state}/{name}"
    last = sorted(children(spark, folder))[-1]
    os.remove(f"{folder}/{last}/manifest.json")  # as if the write had been stopped
    again = N.fit(data, 3, 0.0, 2, tol=-1, state=state)
    assert again.losses == pytest.approx(N.fit(data, 3, 0.0, 2, tol=-1).losses)
    with pytest.raises(ValueError, match="another fit"):
        N.fit(data, 3, 0.0, 3, tol=-1, state=state)


def test_a_stopped_training_goes_on(spark, tmp_path, monkeypatch):
    log = synthetic_events(spark, [f"event {i}" for i in range(8)], persons=80, events_per_person=10)
    options = {"sizes": (2, 3), "regularizations": (0.0,), "iterations": (4,), "measure": "MSE", "tol": -1.0}
    whole = training.train_embeddings(log, **options)
    saves, plain = [], RoundStates.save

    def stopped(self, *args):
        if len(saves) == 6:  # in the fit on both sides
            raise Stop
        saves.append(1)
        return plain(self, *args)

    with monkeypatch.context() as m:
        m.setattr(RoundStates, "save", stopped)
        with pytest.raises(Stop):
            training.train_embeddings(log, **options, state=str(tmp_path / "s"))
    rest = training.train_embeddings(log, **options, state=str(tmp_path / "s"))
    a, b = (dict(map(lambda r: (r.feature_name, r.embedding), t.embeddings.collect())) for t in (whole, rest))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
    for x, y in zip(as_set(whole.scores), as_set(rest.scores), strict=True):
        assert x == pytest.approx(y)
