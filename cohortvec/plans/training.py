"""From an event log to feature embeddings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cooccurrence import cooccurrence, cooccurrence_ratings
from ..operators.factorization import METRIC_SCHEMA, SCORE_SCHEMA, grid_search
from ..operators.ratings import FEATURE, ITEM, PERSON, cohort_sample, sparse_ratings, split_by_person
from ..session import scratch
from ..sources import sinks
from ..sources.commits import manifest, staged

# Default settings for persons x features ..
SIZES, REGULARIZATIONS, ITERATIONS = (50,), (0.05,), (10_000,)
SPLIT_RATIO, SPLIT_SEED, MEASURE = 0.9, 42, "similarity_variance"
# .. and for features x features.
COOC_SIZES, COOC_REGULARIZATIONS, COOC_ITERATIONS = (100,), (0.0,), (20,)
COOC_SPLIT_RATIO = 0.1
# Fixed value: share of persons in a trial run.
SAMPLE_FRACTION = 0.01


class Trained(NamedTuple):
    embeddings: DataFrame  # (item, feature_name, embedding)
    features: DataFrame  # (feature_name, item)
    metrics: DataFrame  # (metric, value, dataset)
    scores: DataFrame  # one row per tried setting


def _train(log: DataFrame, make, key: str, settings: tuple, ratio: float, seed: int, measure: str, workers: int, solver) -> Trained:
    """Ratings, split, grid search; only what is returned stays in the shared folder."""
    sizes, regularizations, iterations = (list(x) for x in settings)
    with scratch(log.sparkSession) as tables:
        indexed = make(log)
        features = tables.keep(indexed.features, "features")
        train, test = split_by_person(indexed.ratings, indexed.persons, ratio, seed, key)
        result = grid_search(
            train, test, features.count(), sizes, regularizations, iterations, measure, workers, unique_cells=True, **solver
        )
        named = result.items.join(features.select(FEATURE, ITEM), ITEM).select(ITEM, FEATURE, "embedding")
        return Trained(tables.keep(named, "embeddings"), features, result.metrics, result.scores)


def train_embeddings(
    log: DataFrame,
    sizes=SIZES,
    regularizations=REGULARIZATIONS,
    iterations=ITERATIONS,
    ratio: float = SPLIT_RATIO,
    seed: int = SPLIT_SEED,
    measure: str = MEASURE,
    workers: int = 1,
    sample: float | None = None,
    **solver,
) -> Trained:
    """Embeddings from persons x features; ``sample`` takes that share of the persons.

    ``solver``: further arguments of ``grid_search``; with ``state`` a training that
    was stopped goes on from its last whole round when it is called again.
    """
    if sample is not None:
        log = cohort_sample(log, sample, seed)
    settings = sizes, regularizations, iterations
    return _train(log, lambda x: sparse_ratings(x, mode="sum"), PERSON, settings, ratio, seed, measure, workers, solver)


def train_cooccurrence_embeddings(
    log: DataFrame,
    sizes=COOC_SIZES,
    regularizations=COOC_REGULARIZATIONS,
    iterations=COOC_ITERATIONS,
    ratio: float = COOC_SPLIT_RATIO,
    seed: int = SPLIT_SEED,
    measure: str = MEASURE,
    workers: int = 1,
    sample: float | None = None,
    **solver,
) -> Trained:
    """Embeddings from feature co-occurrence; rows of the count table are split."""
    if sample is not None:
        log = cohort_sample(log, sample, seed)
    settings = sizes, regularizations, iterations
    return _train(
        log, lambda x: cooccurrence_ratings(cooccurrence(x)), FEATURE, settings, ratio, seed, measure, workers, solver
    )


def save_training(trained: Trained, folder: str, file_format: str = "parquet") -> None:
    """Embeddings, feature index, metrics and scores below a folder that must be new.

    All are committed together: what a stopped call leaves has no manifest, and
    ``read_training`` does not take it.
    """
    spark = trained.embeddings.sparkSession
    with staged(spark, folder, {"format": file_format}) as parts:
        sinks.write_embeddings(trained.embeddings, parts.path("embeddings"), file_format)
        sinks.write_index(trained.features, parts.path("features"), file_format)
        sinks.write_metrics(trained.metrics, parts.path("metrics"))
        sinks.write_metrics(trained.scores, parts.path("scores"))


def read_training(spark: SparkSession, folder: str) -> Trained:
    """What ``save_training`` has committed; ``NotCommitted`` for anything else."""
    file_format = manifest(spark, folder)["about"]["format"]
    if file_format == "csv":
        read = spark.read.option("header", "true")
        wide = read.csv(f"{folder}/embeddings")
        vector = [F.col(c).cast("double") for c in wide.columns if c.startswith(sinks.COLUMN_PREFIX)]
        embeddings = wide.select(F.col(ITEM).cast("bigint").alias(ITEM), FEATURE, F.array(*vector).alias(sinks.VECTOR))
        features = read.csv(f"{folder}/features").select(FEATURE, F.col(ITEM).cast("bigint").alias(ITEM))
    else:
        embeddings, features = spark.read.parquet(f"{folder}/embeddings"), spark.read.parquet(f"{folder}/features")
    metrics = spark.read.schema(METRIC_SCHEMA).json(f"{folder}/metrics")
    scores = spark.read.schema(SCORE_SCHEMA).json(f"{folder}/scores")
    return Trained(embeddings, features, metrics, scores)
