"""From an event log to rating tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction
from ..session import store
from .indexing import BROADCAST_BYTES, KeyIndex, attach_index, build_key_index, salted_join

PERSON, FEATURE = "person_id", "feature_name"
USER, ITEM, RATING = "user", "item", "rating"

# Features per block when the complete person x feature grid is laid out.
GRID_BLOCK = 10_000
# Copies of one repeated event that a single row expands to.
REPEAT_BLOCK = 1_000_000


class Ratings(NamedTuple):
    ratings: DataFrame
    persons: DataFrame
    features: DataFrame


class IndexedLog(NamedTuple):
    """The log reduced to distinct pairs with counts, and both indexes."""

    pairs: DataFrame  # (person_id, feature_name, n)
    persons: KeyIndex
    features: KeyIndex


def index_log(log: DataFrame) -> IndexedLog:
    """Read the log once, count equal events and index persons and features.

    Everything later works on the counted pairs, so neither a person nor a
    feature nor a repeated event with a large share of the log is re-shuffled
    row by row.  Runs jobs.
    """
    counted = log.groupBy(PERSON, FEATURE).agg(F.count(F.lit(1)).alias("n"))
    pairs = store(counted, "pairs").df
    with ThreadPoolExecutor(2) as pool:  # two independent sets of jobs
        persons = pool.submit(build_key_index, pairs, PERSON, USER)
        features = pool.submit(build_key_index, pairs, FEATURE, ITEM)
        return IndexedLog(pairs, persons.result(), features.result())


def _repeat(df: DataFrame, count: str, block: int) -> DataFrame:
    """One row per counted event, in bounded steps."""
    if df.filter(F.col(count) > block).isEmpty():
        return df.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count))).alias("_i")).drop(
            "_i", count
        )
    steps = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / block))
    stepped = df.select("*", F.explode(steps).alias("_step"))
    size = F.least(F.lit(block), F.col(count) - F.col("_step") * block)
    return (
        stepped.withColumn("_size", size)
        .repartition(*df.columns, "_step")
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_size"))).alias("_i"))
        .drop("_i", "_step", "_size", count)
    )


def sparse_ratings(log: DataFrame, mode: str = "rows", repeat_block: int = REPEAT_BLOCK) -> Ratings:
    """Indexed ratings of the events in the log.

    ``rows``: one rating of 1 per log row; ``sum``: one row per pair with the
    event count; ``dedupe``: one row per pair with rating 1.
    """
    if mode not in ("rows", "sum", "dedupe"):
        raise ValueError("mode must be 'rows', 'sum' or 'dedupe'")
    indexed = index_log(log)
    joined = attach_index(indexed.pairs, indexed.features, [PERSON])
    joined = attach_index(joined, indexed.persons, [FEATURE])
    if mode == "sum":
        ratings = joined.select(USER, ITEM, F.col("n").alias(RATING))
    elif mode == "dedupe":
        ratings = joined.select(USER, ITEM, F.lit(1).cast("bigint").alias(RATING))
    else:
        ratings = _repeat(joined.select(USER, ITEM, "n"), "n", repeat_block).select(
            USER, ITEM, F.lit(1).cast("bigint").alias(RATING)
        )
    return Ratings(ratings, indexed.persons.pairs, indexed.features.pairs)


def sum_duplicates(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): ratings at equal coordinates are added."""
    return ratings.groupBy(USER, ITEM).agg(F.sum(RATING).alias(RATING))


def _grid(indexed: IndexedLog, row_key: str, cell_key: str, block_size: int) -> DataFrame:
    """Counts for every (person, feature) pair, 0 where there was no event.

    ``row_key`` is the person or its index, ``cell_key`` the feature or its
    index.  Features are cut into blocks of at most ``block_size``; a person's
    events of one block and the block's cell list are each a bounded array.
    Missing cells are found inside the row, so the grid is never shuffled.
    """
    blocks = -(-max(indexed.features.keys, 1) // block_size)
    block_of = F.floor(F.col(ITEM) / block_size).cast("int")
    cells = (
        indexed.features.table.filter(F.col(FEATURE).isNotNull())
        .groupBy(block_of.alias("_block"))
        .agg(F.collect_list(cell_key).alias("_cells"))
    )
    events = attach_index(indexed.pairs, indexed.features, [PERSON])
    persons = indexed.persons.table
    if row_key == USER:
        events = attach_index(events, indexed.persons, [FEATURE])
        persons = persons.filter(F.col(PERSON).isNotNull())
    events = events.select(
        row_key, block_of.alias("_block"), F.struct(cell_key, F.col("n").alias("active")).alias("_event")
    )
    every_block = persons.select(
        row_key,
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
        F.lit(None).cast(events.schema["_event"].dataType).alias("_event"),
    )
    per_row = (
        events.unionByName(every_block).groupBy(row_key, "_block").agg(F.collect_list("_event").alias("_events"))
    )
    if indexed.features.bytes <= BROADCAST_BYTES:
        rows = per_row.join(F.broadcast(cells), "_block")
    else:
        # few blocks and many persons: spread each block over salted copies
        copies = 1024
        salted = cells.select(
            "_block", "_cells", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_salt")
        )
        salt = F.pmod(F.xxhash64(row_key), F.lit(copies)).cast("int")
        rows = per_row.withColumn("_salt", salt).join(salted, ["_block", "_salt"])
    missing = F.array_except("_cells", F.col(f"_events.{cell_key}"))
    zeros = F.transform(
        missing, lambda c: F.struct(c.alias(cell_key), F.lit(0).cast("bigint").alias("active"))
    )
    return rows.select(row_key, F.inline(F.concat("_events", zeros)))


def _active(grid: DataFrame, binary: bool) -> DataFrame:
    return grid.withColumn("active", F.least("active", F.lit(1).cast("bigint"))) if binary else grid


def full_narrow_master(log: DataFrame, binary: bool = False, block_size: int = GRID_BLOCK) -> DataFrame:
    """``(person_id, feature_name, active)`` for the complete grid.

    ``active`` is the number of events, or 0/1 with ``binary``.
    """
    return _active(_grid(index_log(log), PERSON, FEATURE, block_size), binary)


def dense_ratings(log: DataFrame, binary: bool = False, block_size: int = GRID_BLOCK) -> Ratings:
    """Indexed ratings over the complete grid, zeros included."""
    indexed = index_log(log)
    grid = _active(_grid(indexed, USER, ITEM, block_size), binary)
    ratings = grid.select(USER, ITEM, F.col("active").alias(RATING))
    return Ratings(ratings, indexed.persons.pairs, indexed.features.pairs)


def cohort_sample(log: DataFrame, fraction: float = 0.01, seed: int = 42, person: str = PERSON) -> DataFrame:
    """All events of a random ``fraction`` of the persons.

    A person is in or out by a hash of the id, so this is a filter on the scan:
    no distinct, no join, no shuffle, and the same cohort on every run.
    """
    return log.filter(hash_fraction(F.col(person), seed) < F.lit(fraction))


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame


def split_by_person(
    ratings: DataFrame, persons: DataFrame, ratio: float, seed: int = 42, person: str = PERSON
) -> Split:
    """Persons (not cells) go to train or test; users are numbered anew from 0.

    One index over (side, user) numbers both sides at once, and one join adds
    it to the ratings.  The result is written once, a folder for each side, and
    both sides read it back.  Runs jobs.
    """
    side = (hash_fraction(F.col(person), seed) >= F.lit(ratio)).cast("int")
    sided = persons.select(F.struct(side.alias("side"), F.col(USER)).alias("_key"))
    index = build_key_index(sided, "_key", "_position")
    first_test = index.table.filter(F.col("_key.side") == 1).agg(F.min("_position")).first()[0] or 0
    numbers = index.table.select(
        F.col(f"_key.{USER}").alias(USER),
        F.col("_key.side").alias("_side"),
        (F.col("_position") - F.col("_key.side") * F.lit(first_test)).alias("_number"),
    )
    if index.bytes <= BROADCAST_BYTES:
        moved = ratings.join(F.broadcast(numbers), USER)
    else:
        ratings = store(ratings, "ratings").df  # counted and joined
        sizes = store(ratings.groupBy(USER).agg(F.count(F.lit(1)).alias("_rows")), "user-sizes").df
        total = sizes.agg(F.sum("_rows")).first()[0] or 0
        moved = salted_join(ratings, numbers.join(sizes, USER), USER, total, [ITEM])

    split = store(moved.select("_side", "_number", ITEM, RATING), "split", partition_by="_side").df

    def one_side(value: int) -> DataFrame:
        return split.filter(F.col("_side") == value).select(F.col("_number").alias(USER), ITEM, RATING)

    return Split(one_side(0), one_side(1))
