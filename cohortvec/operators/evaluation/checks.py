"""Input checks shared by the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Default column names of rating and recommendation tables.
USER, ITEM, RATING = "userID", "itemID", "rating"
PREDICTION, RELEVANCE, TIMESTAMP = "prediction", "relevance", "timestamp"
SIMILARITY, FEATURES = "sim", "features"
# Default list length and rating threshold.
K, THRESHOLD = 10, 10


def require_columns(df: DataFrame, columns: list[str], label: str) -> None:
    if not isinstance(df, DataFrame) and not hasattr(df, "sparkSession"):
        raise TypeError(f"{label} must be a Spark DataFrame")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks columns {missing}; it has {df.columns}")


def require_rows(df: DataFrame, label: str) -> None:
    """Runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(f"{label} is empty")
