"""Bounds on what is broadcast and on what a task holds at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import bound_arrow_batches, store

# Rows of a few numbers or hashes; about 64 MB as a hash table.
BROADCAST_ROWS = 500_000


# Rows with whole texts that travel to Python in one Arrow batch.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and a few MB, for rows with whole texts.

    Both the JVM and Python hold a batch several times over; a smaller setting
    of the session stays.
    """
    bound_arrow_batches(spark)
    rows = int(spark.conf.get(BATCH_SETTING))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def join_counted(
    large: DataFrame, small: DataFrame, rows: int, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a table of ``rows`` narrow rows: broadcast up to ``limit``, else shuffled."""
    return large.join(F.broadcast(small) if rows <= limit else small, on, how)


def store_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The written table and its number of rows, from one job."""
    seen = Observation()
    table = store(df.observe(seen, F.count(F.lit(1)).alias("n")), label).df
    return table, seen.get["n"]


def row_key(id_col: str, text: Column) -> Column:
    """One bigint for an id, null or not, and a text; rows that repeat both share it."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text)


def keep_rows(docs: DataFrame, gone: DataFrame, key: Column, label: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` (never null) is in ``gone`` (one column).

    Few keys are broadcast, so the texts stay where they are.
    """
    name = unused_name(docs, "_gone_key")
    keys, n = store_counted(gone.toDF(name).distinct(), label)
    return join_counted(docs.withColumn(name, key), keys, n, [name], "left_anti").select(*docs.columns)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, longer until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
