"""Share of targets recalled against the number of recommended features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import require_columns

# Curve points that are summed by one task.
CURVE_BLOCK = 100_000


def target_positions(
    lists: DataFrame,
    targets: DataFrame,
    point: str = "point_id",
    feature: str = "feature_name",
    position: str = "position",
) -> DataFrame:
    """``(point, rank)`` of each target once the query items left the list.

    Each list names a feature once.  A target that is absent, or itself a
    query item, has no rank.
    """
    query = F.transform(F.array_distinct("query"), lambda q: F.struct(q.alias(feature), F.lit(False).alias("_hit")))
    target = F.when(
        ~F.array_contains("query", F.col("target")),
        F.array(F.struct(F.col("target").alias(feature), F.lit(True).alias("_hit"))),
    ).otherwise(F.array())
    wanted = targets.select(point, F.inline(F.concat(query, target)))
    found = lists.join(wanted, [point, feature]).groupBy(point).agg(
        F.max(F.when(F.col("_hit"), F.col(position))).alias("_at"),
        F.collect_list(F.when(~F.col("_hit"), F.col(position))).alias("_removed"),
    )  # as many entries as the point's query array
    earlier = F.size(F.filter("_removed", lambda p: p < F.col("_at")))
    ranks = found.select(point, (F.col("_at") - earlier).alias("rank"))
    return targets.select(point).join(ranks, point, "left")


def recall_curve(
    lists: DataFrame,
    targets: DataFrame,
    point: str = "point_id",
    feature: str = "feature_name",
    position: str = "position",
    block: int = CURVE_BLOCK,
) -> DataFrame:
    """``(k, recall)`` for k = 0 .. longest list: share of targets ranked below k.

    Runs one job for the longest list and the number of points.
    """
    require_columns(lists, [point, feature, position], "lists")
    require_columns(targets, [point, "query", "target"], "targets")
    spark = lists.sparkSession
    longest = lists.groupBy(point).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    points = targets.count()
    if longest is None or points == 0:
        raise ValueError("lists and targets must not be empty")
    found = (
        target_positions(lists, targets, point, feature, position)
        .filter(F.col("rank").isNotNull())
        .groupBy((F.col("rank") + 1).cast("bigint").alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    curve = (
        spark.range(longest + 1)
        .select(F.col("id").alias("k"))
        .join(found, "k", "left")
        .select("k", F.floor(F.col("k") / block).alias("_block"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    inside = Window.partitionBy("_block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # one row per block of the curve
    totals = found.groupBy(F.floor(F.col("k") / block).alias("_block")).agg(F.sum("n").alias("_total"))
    later = totals.select(
        F.explode(F.sequence(F.col("_block") + 1, F.lit(longest // block + 1))).alias("_block"), "_total"
    )
    starts = later.groupBy("_block").agg(F.sum("_total").alias("_start"))
    return curve.withColumn("_sum", F.sum("n").over(inside)).join(starts, "_block", "left").select(
        "k", ((F.coalesce("_start", F.lit(0)) + F.col("_sum")) / F.lit(points)).alias("recall")
    )
