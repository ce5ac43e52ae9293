"""Event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.hashing import hash_fraction
from ..operators.indexing import BROADCAST_BYTES, build_key_index

PERSON, FEATURE = "person_id", "feature_name"


def scan_interactions(spark: SparkSession, path: str, person: str = PERSON, feature: str = FEATURE) -> DataFrame:
    """``(person_id, feature_name)`` from parquet; only these two columns are read."""
    schema = StructType([StructField(person, LongType()), StructField(feature, StringType())])
    events = spark.read.schema(schema).parquet(path)
    return events.select(F.col(person).alias(PERSON), F.col(feature).alias(FEATURE))


def synthetic_events(
    spark: SparkSession,
    features: DataFrame | list[str],
    persons: int = 10_000,
    events_per_person: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Uniform random log for trials: ``persons * events_per_person`` rows.

    ``features`` is a list of names or a DataFrame with ``feature_name``.  Each
    row is drawn by a hash of its number, so the table does not depend on
    partitioning.  Runs jobs to number the features.
    """
    if not isinstance(features, DataFrame):
        features = spark.createDataFrame([(f,) for f in features], f"{FEATURE} string")
    index = build_key_index(features, FEATURE, "_item")
    draw = lambda name, size: F.floor(
        hash_fraction(F.concat(F.lit(name), F.col("id")), seed) * F.lit(size)
    ).cast("bigint")
    drawn = spark.range(persons * events_per_person).select(
        draw("person", persons).alias(PERSON), draw("feature", index.keys).alias("_item")
    )
    # drawn evenly, so no number is hot
    names = F.broadcast(index.pairs) if index.bytes <= BROADCAST_BYTES else index.pairs
    return drawn.join(names, "_item").select(PERSON, FEATURE)
