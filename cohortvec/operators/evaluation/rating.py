"""Rating metrics: predicted against true ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import ITEM, PREDICTION, RATING, USER, require_columns, require_rows


def rating_pairs(
    true: DataFrame,
    predicted: DataFrame,
    user: str = USER,
    item: str = ITEM,
    rating: str = RATING,
    prediction: str = PREDICTION,
) -> DataFrame:
    """``(label, prediction)`` for every (user, item) in both tables."""
    require_columns(true, [user, item, rating], "true ratings")
    require_columns(predicted, [user, item, prediction], "predicted ratings")
    labels = true.select(user, item, F.col(rating).cast("double").alias("label"))
    guesses = predicted.select(user, item, F.col(prediction).cast("double").alias("prediction"))
    return labels.join(guesses, [user, item]).select("label", "prediction")


def rating_metrics(true: DataFrame, predicted: DataFrame, check_rows: bool = True, **columns) -> DataFrame:
    """One row with ``rmse``, ``mae``, ``rsquared`` and ``exp_var``.

    One join and one aggregate for all four.  A ratio over a label variance of
    0 is null.
    """
    pairs = rating_pairs(true, predicted, **columns)
    if check_rows:
        require_rows(true, "true ratings")
        require_rows(predicted, "predicted ratings")
    error = F.col("label") - F.col("prediction")
    squares = F.sum(error * error)
    spread = F.var_pop("label") * F.count("label")
    return pairs.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(squares, spread)).alias("rsquared"),
        (1 - F.try_divide(F.var_samp(error), F.var_samp("label"))).alias("exp_var"),
    )
