"""Connected groups of codes and one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import Stored, bound_arrow_batches, store
from . import indexing

# Pairs, and bytes of them, that a task joins at a time.
PIECE_PAIRS, PIECE_BYTES = 1 << 20, 64 * 1024 * 1024


def _smallest_linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` numbers the smallest one that the pairs link it with."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    """Codes of the pairs, each beside the smallest code they link it with; that one is left out."""
    ends = pa.chunked_array([b.column(c) for c in ("u", "v") for b in batches]).combine_chunks()
    coded = ends.dictionary_encode()
    codes = coded.dictionary
    order = pc.array_sort_indices(codes).to_numpy()
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.arange(len(codes))
    u, v = np.split(rank[coded.indices.to_numpy()], 2)
    label = _smallest_linked(u, v, len(codes))
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes.take(pa.array(order[moved])), codes.take(pa.array(order[label[moved]]))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of a piece of pairs as pairs (code, smallest code), with the piece's number."""
    piece = TaskContext.get().partitionId() << 32
    waiting, rows, size = [], 0, 0

    def handed() -> pa.RecordBatch:
        u, v = _joined(waiting)
        return pa.RecordBatch.from_arrays([u, v, pa.array(np.full(len(u), piece))], ["u", "v", "piece"])

    for batch in batches:
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PIECE_PAIRS or size >= PIECE_BYTES:
            yield handed()
            piece, waiting, rows, size = piece + 1, [], 0, 0
    if rows:
        yield handed()


def _store_stars(edges: DataFrame) -> tuple[Stored, dict]:
    """Join the pairs piece by piece where they lie; rows and pieces come with the same job."""
    bound_arrow_batches(edges.sparkSession)
    seen = Observation()
    schema = StructType([*edges.schema.fields]).add("piece", LongType())
    stars = edges.mapInArrow(_stars, schema).observe(
        seen, F.count(F.lit(1)).alias("n"), F.min("piece").alias("first"), F.max("piece").alias("last")
    )
    return store(stars, "stars"), seen.get


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("u").alias("v")),
    )
    return edges.select(F.inline(ends))


def _centres(edges: DataFrame, salt: int) -> DataFrame:
    """``(node, centre, _rows)``: of a node and its neighbours the one that a hash puts first.

    Codes in the order of a chain would move by one link a round; in a random
    order every other node is a centre at most, on average.
    """
    def placed(c: str):
        return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("code"))

    around = _both_ways(edges).groupBy("u").agg(F.min(placed("v")).alias("first"), F.count(F.lit(1)).alias("_rows"))
    return around.select(F.col("u").alias("node"), F.least(placed("u"), "first")["code"].alias("centre"), "_rows")


def _between_centres(edges: DataFrame, centres: DataFrame, total: int) -> DataFrame:
    """The pairs with their codes replaced by the centres; a code of many pairs is cut."""
    for c, other in (("u", "v"), ("v", "u")):
        lookup = centres.select(F.col("node").alias(c), F.col("centre").alias("_centre"), "_rows")
        edges = indexing.salted_join(edges, lookup, c, total, [other]).select(F.col("_centre").alias(c), other)
    return _ordered(edges, "u", "v")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of unequal codes, the larger one first."""
    return (
        pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )


def connected_groups(
    pairs: DataFrame, first: str = "CUI1", second: str = "CUI2", node: str = "node", group: str = "group"
) -> DataFrame:
    """``(node, group)``: all codes linked by pairs, group named by its smallest code.

    Tasks join the pairs that they hold.  While that leaves several pieces, every
    code moves to one of its neighbours and the pairs go on between those, about
    half as many each round; so the rounds grow with the logarithm of the number
    of codes, and all rounds together take about as long as the first two.  At the
    end codes follow their moves and groups are named.  Codes are numbers, texts
    or dates.  Runs jobs: each round is written to the shared folder, which cuts
    lineage.
    """
    clean = pairs.select(F.col(first).alias("a"), F.col(second).alias("b")).dropna()
    loops = clean.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    stars, state = _store_stars(_ordered(clean, "a", "b"))
    moves = []
    while state["first"] != state["last"]:  # both null without pairs
        edges = stars.df.select("u", "v")
        # two rounds in one order: the second takes all members of a star to its centre
        moves.append(store(_centres(edges, len(moves) // 2), "centres"))
        between = _between_centres(edges, moves[-1].df, 2 * state["n"])
        smaller, state = _store_stars(between)
        stars.discard()
        stars = smaller
    members = stars.df.select(F.col("u").alias("node"), F.col("v").alias("group"))
    roots = stars.df.select(F.col("v").alias("node"), F.col("v").alias("group"))
    grouped = members.unionByName(roots.distinct())  # members and roots are never the same node
    if moves:
        grouped = _follow(grouped, moves)
        stars.discard()
    alone = loops.distinct().join(grouped.select("node"), "node", "left_anti").select(
        "node", F.col("node").alias("group")
    )
    return grouped.unionByName(alone).select(F.col("node").alias(node), F.col("group").alias(group))


def _follow(grouped: DataFrame, moves: list[Stored]) -> DataFrame:
    """Groups of all codes from those of the last centres; a centre without pairs is a group."""
    total = 0
    for move in reversed(moves):
        seen = Observation()
        of_centre = grouped.select(F.col("node").alias("centre"), "group")
        grouped = store(
            move.df.join(of_centre, "centre", "left")
            .select("node", F.coalesce("group", "centre").alias("group"))
            .observe(seen, F.count(F.lit(1)).alias("n")),
            "moved",
        ).df
        total = seen.get["n"]
        move.discard()
    names = store(grouped.groupBy("group").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("_rows")), "names").df
    return indexing.salted_join(grouped, names, "group", total, ["node"]).select("node", F.col("name").alias("group"))


def group_representatives(
    pairs: DataFrame,
    groups: DataFrame,
    first: str = "CUI1",
    order: str = "line_no",
    node: str = "node",
    group: str = "group",
) -> DataFrame:
    """``(group, representative)``: first code of the earliest pair of each group."""
    keyed = pairs.filter(F.col(first).isNotNull()).select(F.col(first).alias(node), order)
    # one row per code before the join: a code with many pairs is no hot key
    earliest = keyed.groupBy(node).agg(F.min(order).alias(order))
    return (
        earliest.join(groups, node)
        .groupBy(group)
        .agg(F.min_by(node, order).alias("representative"))
    )
