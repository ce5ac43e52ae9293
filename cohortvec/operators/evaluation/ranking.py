"""Recommended lists per user, and ranking metrics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..positions import positions, top_rows
from .checks import ITEM, K, PREDICTION, RATING, THRESHOLD, TIMESTAMP, USER, require_columns


def top_k_items(
    df: DataFrame, k: int = K, user: str = USER, item: str = ITEM, score: str = RATING
) -> DataFrame:
    """``(user, item, rank)``: the k best scored items; ties go to the smaller item."""
    rows = df.select(user, item, score)
    return top_rows(rows, user, [F.col(score).desc(), F.col(item)], k).select(user, item, "rank")


def latest_k_items(
    df: DataFrame, k: int = K, user: str = USER, item: str = ITEM, timestamp: str = TIMESTAMP
) -> DataFrame:
    """``(user, item, rank)``: the k most recent items; ties go to the smaller item."""
    rows = df.select(user, item, timestamp)
    return top_rows(rows, user, [F.col(timestamp).desc(), F.col(item)], k).select(user, item, "rank")


def threshold_items(
    df: DataFrame, threshold: float = THRESHOLD, user: str = USER, item: str = ITEM, score: str = RATING, **limits
) -> DataFrame:
    """``(user, item, rank)``: all items scored at least ``threshold``, best first.

    The list is not cut.  Runs the size check of ``positions``.
    """
    rows = df.select(user, item, score).filter(F.col(score) >= threshold)
    return positions(rows, user, [F.col(score).desc(), F.col(item)], "rank", **limits).select(user, item, "rank")


def as_lists(ranked: DataFrame, user: str = USER, item: str = ITEM, name: str = PREDICTION) -> DataFrame:
    """``(user, ARRAY<item>)`` in rank order, for lists cut to a small k."""
    entries = F.array_sort(F.collect_list(F.struct("rank", item)))
    return ranked.groupBy(user).agg(F.transform(entries, lambda e: e[item]).alias(name))


# The ways to choose a user's recommended items.
RELEVANCY_METHODS = ("top_k", "by_time_stamp", "by_threshold")


def recommended_items(
    predicted: DataFrame,
    method: str = "top_k",
    k: int = K,
    threshold: float = THRESHOLD,
    user: str = USER,
    item: str = ITEM,
    prediction: str = PREDICTION,
) -> DataFrame:
    if method == "top_k":
        return top_k_items(predicted, k, user, item, prediction)
    if method == "by_time_stamp":
        return latest_k_items(predicted, k, user, item, prediction)
    if method == "by_threshold":
        return threshold_items(predicted, threshold, user, item, prediction)
    raise ValueError(f"method must be one of {RELEVANCY_METHODS}")


def ranking_metrics(
    true: DataFrame,
    predicted: DataFrame,
    k: int = K,
    method: str = "top_k",
    threshold: float = THRESHOLD,
    user: str = USER,
    item: str = ITEM,
    rating: str = RATING,
    prediction: str = PREDICTION,
) -> DataFrame:
    """One row: ``precision_at_k``, ``recall_at_k``, ``ndcg_at_k``, ``map_at_k``.

    Means over users with both a recommended list and true items.  Works on
    (user, item, rank) rows, so no user's items are collected into one row.
    With ``by_time_stamp`` the ``prediction`` column holds the timestamp.
    """
    require_columns(true, [user, item, rating], "true ratings")
    require_columns(predicted, [user, item, prediction], "predicted ratings")
    listed = recommended_items(predicted, method, k, threshold, user, item, prediction)
    truth = true.groupBy(user, item).agg(F.count(F.lit(1)).alias("times"))
    truth_sizes = truth.groupBy(user).agg(
        F.count(F.lit(1)).alias("n_true"), F.sum("times").alias("n_true_rows")
    )
    list_sizes = listed.groupBy(user).agg(F.max("rank").alias("n_listed"))
    hits = listed.join(truth.select(user, item), [user, item])
    if method == "by_threshold":
        hits = positions(hits, user, [F.col("rank")], "nth")
    else:  # at most k hits per user
        hits = top_rows(hits, user, [F.col("rank")], k, "nth")
    gain = 1.0 / F.log(F.col("rank") + 1)
    per_user = hits.groupBy(user).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("rank") <= k).alias("hits_k"),
        F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"),
        F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
    )
    ideal_length = F.least(F.col("n_true"), F.lit(k)).cast("int")
    ideal = F.aggregate(
        F.sequence(F.lit(1), ideal_length), F.lit(0.0), lambda total, i: total + 1.0 / F.log(i + 1)
    )
    zero = F.lit(0)
    return (
        list_sizes.join(truth_sizes, user)
        .join(per_user, user, "left")
        .agg(
            F.avg(F.coalesce("hits_k", zero) / F.lit(k)).alias("precision_at_k"),
            F.avg(F.coalesce("hits", zero) / F.col("n_true_rows")).alias("recall_at_k"),
            F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"),
            F.avg(F.coalesce("precisions", F.lit(0.0)) / F.col("n_true")).alias("map_at_k"),
        )
    )
