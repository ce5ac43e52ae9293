import math
import random

import numpy as np
import pytest
from pyspark.mllib.evaluation import RankingMetrics, RegressionMetrics
from pyspark.sql import functions as F

from cohortvec.operators.evaluation import diversity as D
from cohortvec.operators.evaluation import ranking as K
from cohortvec.operators.evaluation.rating import rating_metrics
from cohortvec.operators.evaluation.recall import recall_curve, target_positions

from .conftest import as_set

TRUE = "userID long, itemID long, rating double"
PRED = "userID long, itemID long, prediction double"


def test_rating_metrics(spark, table):
    true = table([(1, 1, 2.0), (1, 2, 3.5), (1, 3, 4.0), (9, 9, 1.0)], TRUE)
    pred = table([(1, 1, 1.0), (1, 2, 3.0), (1, 3, 5.0), (8, 8, 1.0)], PRED)
    got = rating_metrics(true, pred).first()
    assert got.rmse == pytest.approx(0.8660254) and got.mae == pytest.approx(0.8333333)
    assert got.rsquared == pytest.approx(-0.0384615, rel=1e-5)
    pairs = spark.sparkContext.parallelize([(1.0, 2.0), (3.0, 3.5), (5.0, 4.0)])
    other = RegressionMetrics(pairs)
    assert got.rmse == pytest.approx(other.rootMeanSquaredError) and got.rsquared == pytest.approx(other.r2)
    errors, labels = np.array([1.0, 0.5, -1.0]), np.array([2.0, 3.5, 4.0])
    assert got.exp_var == pytest.approx(1 - errors.var(ddof=1) / labels.var(ddof=1))


def test_constant_labels_have_no_ratio(table):
    got = rating_metrics(table([(1, 1, 2.0), (1, 2, 2.0)], TRUE), table([(1, 1, 1.0), (1, 2, 2.0)], PRED)).first()
    assert got.rsquared is None and got.exp_var is None


def test_bad_inputs(table):
    true, pred = table([(1, 1, 2.0)], TRUE), table([(1, 1, 2.0)], PRED)
    with pytest.raises(ValueError):
        rating_metrics(true.drop("rating"), pred)
    with pytest.raises(ValueError):
        rating_metrics(true.limit(0), pred)
    with pytest.raises(ValueError):
        K.ranking_metrics(true, pred, method="other")
    with pytest.raises(ValueError):
        K.ranking_metrics(true, pred.drop("userID"))
    with pytest.raises(TypeError):
        rating_metrics([1], pred)


def test_ranking_metrics_by_hand(table):
    true = table([(1, i, 1.0) for i in (2, 9, 10, 11)] + [(2, 5, 1.0), (2, 6, 1.0)], TRUE)
    pred = table([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0), (2, 5, 9.0)], PRED)
    got = K.ranking_metrics(true, pred, k=2).first()
    assert (got.precision_at_k, got.ndcg_at_k, got.map_at_k) == pytest.approx((0.5, 0.5, 0.3125))
    assert got.recall_at_k == pytest.approx((1 / 4 + 1 / 2) / 2)


@pytest.mark.parametrize("method, k", [("top_k", 4), ("by_threshold", 3), ("by_time_stamp", 5)])
def test_ranking_metrics_equal_mllib(spark, method, k):
    rng = random.Random(5)
    true = [(u, i, 1.0) for u in range(20) for i in rng.sample(range(30), rng.randint(1, 8)) if u != 3]
    pred = [(u, i, float(s)) for u in range(20) for s, i in enumerate(rng.sample(range(30), 10)) if u != 7]
    tf, pf = spark.createDataFrame(true, TRUE), spark.createDataFrame(pred, PRED)
    got = K.ranking_metrics(tf, pf, k=k, method=method, threshold=4).first()
    lists, truth = {}, {}
    for u, i, _ in true:
        truth.setdefault(u, []).append(i)
    for u, i, s in sorted(pred, key=lambda r: -r[2]):
        if method != "by_threshold" or s >= 4:
            lists.setdefault(u, []).append(i)
    if method != "by_threshold":
        lists = {u: items[:k] for u, items in lists.items()}
    both = [(lists[u], truth[u]) for u in lists if u in truth]
    other = RankingMetrics(spark.sparkContext.parallelize(both))
    assert got.precision_at_k == pytest.approx(other.precisionAt(k))
    assert got.ndcg_at_k == pytest.approx(other.ndcgAt(k))
    assert got.map_at_k == pytest.approx(other.meanAveragePrecision)
    assert got.recall_at_k == pytest.approx(np.mean([len(set(p) & set(t)) / len(t) for p, t in both]))


def test_lists(table):
    df = table([(1, 5, 2.0), (1, 4, 2.0), (1, 3, 9.0), (2, 1, 0.5)], TRUE)
    assert as_set(K.top_k_items(df, 2)) == [(1, 3, 1), (1, 4, 2), (2, 1, 1)]
    assert as_set(K.threshold_items(df, 2)) == [(1, 3, 1), (1, 4, 2), (1, 5, 3)]
    assert as_set(K.threshold_items(df, 2, group_rows=1)) == [(1, 3, 1), (1, 4, 2), (1, 5, 3)]
    assert as_set(K.latest_k_items(df, 1, timestamp="rating")) == [(1, 3, 1), (2, 1, 1)]
    lists = {r[0]: r[1] for r in K.as_lists(K.top_k_items(df, 2)).collect()}
    assert lists == {1: [3, 4], 2: [1]}


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(2)
    train = {(u, i) for u in range(15) for i in rng.sample(range(12), rng.randint(1, 6))}
    reco = {(u, i) for u in range(16) for i in rng.sample(range(14), rng.randint(1, 5))} - train
    reco = sorted((u, i, round(rng.random(), 3)) for u, i in reco)
    return (
        sorted(train),
        reco,
        spark.createDataFrame(sorted(train), "userID long, itemID long"),
        spark.createDataFrame(reco, "userID long, itemID long, relevance double"),
    )


def naive_similarity(train):
    users = {}
    for u, i in train:
        users.setdefault(i, set()).add(u)
    return {
        (a, b): len(users[a] & users[b]) / math.sqrt(len(users[a]) * len(users[b]))
        for a in users
        for b in users
        if a <= b and users[a] & users[b]
    }


def close(df, want):
    got = {tuple(r)[:-1]: r[-1] for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("tile_rows", [2, 4096])
def test_diversity_metrics(history, tile_rows):
    train, reco, tf, rf = history
    sim = naive_similarity(train)
    table = D.cooccurrence_similarity(tf, tile_rows=tile_rows, array_items=0 if tile_rows == 2 else 4096)
    close(table, sim)
    lists, seen = {}, {}
    for u, i, _ in reco:
        lists.setdefault(u, []).append(i)
    for u, i in train:
        seen.setdefault(u, []).append(i)
    similar = {
        u: np.mean([sim.get((a, b), 0.0) for a in items for b in items if a < b]) for u, items in lists.items() if len(items) > 1
    }
    close(D.intralist_similarity(rf, table), {(u,): v for u, v in similar.items()})
    close(D.user_diversity(rf, table), {(u,): 1 - v for u, v in similar.items()})
    assert D.diversity(rf, table).first()[0] == pytest.approx(np.mean([1 - v for v in similar.values()]))
    serendipity = {
        (u, i): (1 - np.mean([sim.get((min(i, j), max(i, j)), 0.0) for j in seen[u]])) * w for u, i, w in reco if u in seen
    }
    per_item = D.user_item_serendipity(tf, rf, table, relevance="relevance", tile_rows=tile_rows).persist()
    close(per_item, serendipity)
    per_user = {}
    for (u, _), v in serendipity.items():
        per_user.setdefault((u,), []).append(v)
    close(D.user_serendipity(per_item), {u: np.mean(v) for u, v in per_user.items()})
    assert D.serendipity(per_item).first()[0] == pytest.approx(np.mean([np.mean(v) for v in per_user.values()]))


def test_novelty_and_coverage(history, table):
    train, reco, tf, rf = history
    counts = {}
    for _, i in train:
        counts[i] = counts.get(i, 0) + 1
    novelty = {i: -math.log2(n / len(train)) for i, n in counts.items()}
    close(D.item_novelty(tf), {(i,): v for i, v in novelty.items()})
    assert D.novelty(tf, rf).first()[0] == pytest.approx(sum(novelty.get(i, 0.0) for _, i, _ in reco) / len(reco))
    items = {i for _, i, _ in reco}
    assert D.catalog_coverage(tf, rf).first()[0] == pytest.approx(len(items) / len(counts))
    halves = table([(1, 1), (2, 2)], "userID long, itemID long")
    assert D.distributional_coverage(halves).first()[0] == pytest.approx(1.0)
    assert D.item_novelty(table([(u, i) for u, i in [(1, 1), (1, 2), (2, 2), (3, 2)]], "userID long, itemID long")).filter(
        "itemID = 1"
    ).first()[1] == pytest.approx(2.0)


def test_overlap_is_an_error(history):
    _, _, tf, rf = history
    D.check_disjoint(tf, rf)
    with pytest.raises(ValueError):
        D.check_disjoint(tf, tf)


def test_item_feature_similarity(spark, table):
    from pyspark.ml.linalg import Vectors

    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])]
    arrays = table(rows, "itemID long, features array<double>")
    want = {(1, 1): 1.0, (1, 2): math.sqrt(0.5), (1, 3): 0.0, (2, 2): 1.0, (2, 3): 0.0, (3, 3): 0.0}
    close(D.item_similarity(None, "item_feature_vector", arrays), want)
    vectors = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in rows], ["itemID", "features"])
    close(D.item_feature_similarity(vectors), want)
    with pytest.raises(ValueError):
        D.item_similarity(arrays, "item_feature_vector")
    with pytest.raises(ValueError):
        D.item_similarity(arrays, "other")


LISTS = "point_id long, feature_name string, position long"
TARGETS = "point_id long, query array<string>, target string"


def test_recall_curve_by_hand(table):
    lists = table([(1, "q", 0), (1, "a", 1), (1, "b", 2)], LISTS)
    assert as_set(recall_curve(lists, table([(1, ["q"], "b")], TARGETS))) == [(0, 0.0), (1, 0.0), (2, 1.0), (3, 1.0)]
    absent = table([(1, ["q"], "b"), (2, ["q"], "zz"), (3, [], "b")], TARGETS)
    assert as_set(recall_curve(lists, absent))[-1] == pytest.approx((3, 1 / 3))
    assert target_positions(lists, table([(1, ["q", "b"], "b")], TARGETS)).first().rank is None
    with pytest.raises(ValueError):
        recall_curve(lists.limit(0), absent)


@pytest.mark.parametrize("block", [3, 100_000])
def test_recall_curve_equals_list_removal(spark, block):
    rng = random.Random(4)
    lists, targets, ranks = [], [], []
    for p in range(25):
        names = [f"f{i}" for i in rng.sample(range(20), rng.randint(3, 15))]
        query, target = rng.sample(names, 2), f"f{rng.randrange(20)}"
        lists += [(p, n, i) for i, n in enumerate(names)]
        targets.append((p, query, target))
        left = [n for n in names if n not in query]
        ranks.append(left.index(target) if target in left else None)
    longest = max(i for _, _, i in lists) + 1
    want = [(k, sum(r is not None and r < k for r in ranks) / 25) for k in range(longest + 1)]
    got = as_set(recall_curve(spark.createDataFrame(lists, LISTS), spark.createDataFrame(targets, TARGETS), block=block))
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [r for _, r in got] == pytest.approx([r for _, r in want])


def test_evaluators(table, history):
    from cohortvec.operators.evaluation.evaluators import DiversityEvaluation, RankingEvaluation, RatingEvaluation

    true = table([(1, 1, 2.0), (1, 2, 3.5), (1, 3, 4.0)], TRUE)
    pred = table([(1, 1, 1.0), (1, 2, 3.0), (1, 3, 5.0)], PRED)
    rated = RatingEvaluation(true, pred)
    assert (rated.rmse(), rated.mae()) == pytest.approx((0.8660254, 0.8333333))
    assert rated.rsquared() == pytest.approx(-1 / 26) and rated.exp_var() == pytest.approx(0.0, abs=1e-9)
    ranked = RankingEvaluation(true, pred, k=2)
    assert (ranked.precision_at_k(), ranked.recall_at_k(), ranked.ndcg_at_k()) == pytest.approx((1.0, 2 / 3, 1.0))
    assert ranked.map_at_k() == pytest.approx(2 / 3)

    train, reco, tf, rf = history
    both = DiversityEvaluation(tf, rf, relevance="relevance")
    sim = D.cooccurrence_similarity(tf)
    per_item = D.user_item_serendipity(tf, rf, sim, relevance="relevance")
    close(both.user_item_serendipity(), {tuple(r)[:2]: r[2] for r in per_item.collect()})
    assert both.serendipity() == pytest.approx(D.serendipity(per_item).first()[0])
    assert both.user_serendipity().count() == D.user_serendipity(per_item).count()
    assert both.diversity() == pytest.approx(D.diversity(rf, sim).first()[0])
    assert both.user_diversity().count() == D.user_diversity(rf, sim).count()
    assert both.novelty() == pytest.approx(D.novelty(tf, rf).first()[0])
    assert both.historical_item_novelty().count() == len({i for _, i in train})
    assert both.catalog_coverage() == pytest.approx(len({i for _, i, _ in reco}) / len({i for _, i in train}))
    assert both.distributional_coverage() > 0
    with pytest.raises(ValueError):
        DiversityEvaluation(tf, tf)
    with pytest.raises(ValueError):
        DiversityEvaluation(tf, rf, measure="item_feature_vector")
    with pytest.raises(ValueError):
        DiversityEvaluation(tf, rf, measure="other")
    vectors = table([(i, [1.0, float(i)]) for i in range(14)], "itemID long, features array<double>")
    by_vector = DiversityEvaluation(tf, rf, vectors, "item_feature_vector")
    assert 0 <= by_vector.diversity() <= 1
