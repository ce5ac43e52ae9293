"""First row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` for each value of ``key``.

    An aggregate, not a window: each map task keeps one row per key, so a key
    with very many rows costs no more than any other.  Rows without a key are
    dropped, since nothing can be looked up by them.
    """
    others = [c for c in df.columns if c != key]
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)
