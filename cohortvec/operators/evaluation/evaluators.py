"""Evaluators that check their inputs once and keep what several metrics share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import store
from . import diversity as div
from .checks import ITEM, K, PREDICTION, RATING, RELEVANCE, THRESHOLD, USER
from .ranking import ranking_metrics
from .rating import rating_metrics


class RatingEvaluation:
    """``rmse``, ``mae``, ``rsquared``, ``exp_var`` as numbers, from one job."""

    def __init__(
        self,
        true: DataFrame,
        predicted: DataFrame,
        user: str = USER,
        item: str = ITEM,
        rating: str = RATING,
        prediction: str = PREDICTION,
    ):
        self.table = rating_metrics(true, predicted, user=user, item=item, rating=rating, prediction=prediction)

    @cached_property
    def _row(self):
        return self.table.first()

    def rmse(self) -> float:
        return self._row["rmse"]

    def mae(self) -> float:
        return self._row["mae"]

    def rsquared(self) -> float | None:
        return self._row["rsquared"]

    def exp_var(self) -> float | None:
        return self._row["exp_var"]


class RankingEvaluation:
    """Precision, recall, nDCG and MAP of recommended lists, from one job."""

    def __init__(
        self,
        true: DataFrame,
        predicted: DataFrame,
        k: int = K,
        method: str = "top_k",
        threshold: float = THRESHOLD,
        user: str = USER,
        item: str = ITEM,
        rating: str = RATING,
        prediction: str = PREDICTION,
    ):
        self.table = ranking_metrics(true, predicted, k, method, threshold, user, item, rating, prediction)

    @cached_property
    def _row(self):
        return self.table.first()

    def precision_at_k(self) -> float:
        return self._row["precision_at_k"]

    def recall_at_k(self) -> float:
        return self._row["recall_at_k"]

    def ndcg_at_k(self) -> float:
        return self._row["ndcg_at_k"]

    def map_at_k(self) -> float:
        return self._row["map_at_k"]


class DiversityEvaluation:
    """Diversity, novelty, serendipity and coverage of recommendations.

    Rejects recommendations that are in the history.  The similarity table and
    the serendipity rows are written once and shared by the metrics on them.
    """

    def __init__(
        self,
        train: DataFrame,
        reco: DataFrame,
        item_features: DataFrame | None = None,
        measure: str = "item_cooccurrence_count",
        user: str = USER,
        item: str = ITEM,
        relevance: str | None = None,
    ):
        if measure not in div.SIMILARITY_MEASURES:
            raise ValueError(f"measure must be one of {div.SIMILARITY_MEASURES}")
        if measure == "item_feature_vector" and item_features is None:
            raise ValueError("item_feature_vector needs a table of item features")
        div.check_disjoint(train, reco, user, item)
        weight = F.col(relevance).cast("double") if relevance else F.lit(1.0)
        self.user, self.item, self.measure, self.item_features = user, item, measure, item_features
        self.train = train.select(user, item)
        self.reco = reco.select(user, item, weight.alias(RELEVANCE))

    @cached_property
    def similarity(self) -> DataFrame:
        table = div.item_similarity(self.train, self.measure, self.item_features, self.user, self.item)
        return table if self.measure == "item_cooccurrence_count" else store(table, "item-similarity").df

    @cached_property
    def _user_diversity(self) -> DataFrame:
        return store(div.user_diversity(self.reco, self.similarity, self.user, self.item), "user-diversity").df

    @cached_property
    def _per_item(self) -> DataFrame:
        rows = div.user_item_serendipity(
            self.train, self.reco, self.similarity, self.user, self.item, relevance=RELEVANCE
        )
        return store(rows, "user-item-serendipity").df

    def user_diversity(self) -> DataFrame:
        return self._user_diversity

    def diversity(self) -> float:
        return self._user_diversity.agg(F.avg("user_diversity")).first()[0]

    def historical_item_novelty(self) -> DataFrame:
        return div.item_novelty(self.train, self.item)

    def novelty(self) -> float:
        return div.novelty(self.train, self.reco, self.item).first()[0]

    def user_item_serendipity(self) -> DataFrame:
        return self._per_item

    def user_serendipity(self) -> DataFrame:
        return div.user_serendipity(self._per_item, self.user)

    def serendipity(self) -> float:
        return div.serendipity(self._per_item, self.user).first()[0]

    def catalog_coverage(self) -> float:
        return div.catalog_coverage(self.train, self.reco, self.item).first()[0]

    def distributional_coverage(self) -> float:
        return div.distributional_coverage(self.reco, self.item).first()[0]
