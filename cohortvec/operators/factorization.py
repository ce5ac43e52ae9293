"""Non-negative matrix factorization of a rating table on the cluster.

Minimises  |X - W H|^2 / 2  +  a M |W|^2 / 2  +  a N |H|^2 / 2  with W, H >= 0,
N users, M items; missing cells count as 0.  Both factors are solved in turn
from small normal equations (size k x k), row by row:

* the user side needs  X H  and  H'H,
* the item side needs  X'W  and  W'W.

W is solved anew from H in each round and never kept.  ``fit`` broadcasts H
while it is small (size checked).  Otherwise both factors are tables and the
ratings lie in tiles of a block of users and a block of items.  A vector goes to
each tile that has ratings for it, once, and a tile hands on one sum per row of
the other side, so what is shuffled grows with the blocks, not with the ratings,
and the tiles stay where they are.  The two ways compute the same numbers.
"""

from __future__ import annotations

import logging
import weakref
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..session import parallelism, store
from .ratings import ITEM, RATING, USER, sum_duplicates
from .rounds import RoundStates

logger = logging.getLogger(__name__)

VECTOR = "embedding"
# Largest item factor (k x M doubles) that is broadcast.
MODEL_BYTES = 64 * 1024 * 1024
# Doubles a task gathers at once while it multiplies its rows.
GATHER_DOUBLES = 4_000_000
# Inner solver: sweeps over the components, and relative change that ends them.
SWEEPS, SWEEP_TOLERANCE = 100, 1e-7
# Stored ratings per partition of the grouped table.
RATINGS_PER_PART = 2_000_000
# Doubles of a block of vectors, and ratings of a tile on average at most.
BLOCK_DOUBLES = 4_000_000
RATINGS_PER_TILE = 2_000_000
# Numbers of the item side that the driver solves itself.
DRIVER_SOLVE = 1_000_000

# First item vectors, as an array column over the item number.
Start = Callable[[Column], Column]


@dataclass
class Factorization:
    items: DataFrame  # (item, embedding)
    rank: int
    regularization: float
    losses: list[float] = field(default_factory=list)
    factor: np.ndarray | None = None  # the item vectors, while the model may be broadcast


def solve_rows(target: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Rows w >= 0 that minimise  w G w' / 2 - w b'  for each row b of ``target``."""
    return solve_rows_counted(target, gram)[0]


def solve_rows_counted(target: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, int]:
    """The rows, and how many of them still changed after SWEEPS sweeps.

    A row is left alone once it has settled, and every sum over components runs
    in their order, so a row's result does not depend on the rows beside it.
    """
    rank = gram.shape[0]
    diagonal = np.diag(gram)
    wanted = np.ascontiguousarray(target.T)  # rank x rows
    inverse = np.linalg.pinv(gram, hermitian=True)
    # rows that are open lie side by side; what has settled is put back in its place
    own, aim = np.maximum(_in_order(inverse, wanted), 0.0), wanted
    settled, places = np.empty_like(own), np.arange(own.shape[1])
    for _ in range(SWEEPS):
        scale = np.maximum(own.max(axis=0, initial=0.0), 1e-30)
        change, moved, step = (np.zeros(len(places)) for _ in range(3))
        for j in range(rank):
            if diagonal[j] <= 0.0:
                own[j] = 0.0
                continue
            np.multiply(own[0], gram[j, 0], out=moved)
            for i in range(1, rank):
                moved += np.multiply(own[i], gram[j, i], out=step)
            np.subtract(aim[j], moved, out=moved)
            moved /= diagonal[j]
            moved += own[j]
            np.maximum(moved, 0.0, out=moved)
            np.abs(np.subtract(moved, own[j], out=step), out=step)
            np.maximum(change, step, out=change)
            own[j] = moved
        still = change > SWEEP_TOLERANCE * scale
        if still.all():
            continue
        settled[:, places[~still]] = own[:, ~still]
        places = places[still]
        own, aim = np.compress(still, own, axis=1), np.compress(still, aim, axis=1)
        if not len(places):
            break
    settled[:, places] = own
    return settled.T, len(places)


def _in_order(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Matrix product with the terms of every sum added one after the other."""
    out = np.zeros((matrix.shape[0], columns.shape[1]))
    for j in range(matrix.shape[1]):
        out += matrix[:, j, None] * columns[j]
    return out


# Increment and multipliers of the public SplitMix64 generator.
MIX_STEP, MIX_FIRST, MIX_SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def start_vectors(items: np.ndarray, rank: int, scale: float, seed: int) -> np.ndarray:
    """Half-normal random start of each item's vector.

    A number depends only on seed, item and dimension, so every run, batch and
    cluster starts from the same factor.
    """

    def uniform(stream: int) -> np.ndarray:
        cell = np.asarray(items, dtype=np.uint64)[:, None] * np.uint64(rank) + np.arange(rank, dtype=np.uint64)
        with np.errstate(over="ignore"):
            x = (cell * np.uint64(2) + np.uint64(stream + 1)) * np.uint64(MIX_STEP) + np.uint64(seed) * np.uint64(MIX_SECOND)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_FIRST)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_SECOND)
            x ^= x >> np.uint64(31)
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53

    normal = np.sqrt(-2.0 * np.log(uniform(0))) * np.cos(2.0 * np.pi * uniform(1))
    return np.abs(normal) * scale


@dataclass(frozen=True)
class CellFacts:
    cells: int
    users: int
    mean: float  # over all user x item cells
    squares: float


def _unpersist(tiles: dict[int, Tiles]) -> None:
    while tiles:
        tiles.popitem()[1].cells.unpersist()


class RatingCells:
    """A rating table prepared for several fits.

    ``cells`` has one row per non-zero (user, item).  ``rows`` groups them per
    user for models that are broadcast; their item number is then bounded by
    the model size, and a user's arrays are no longer than that.
    """

    def __init__(self, ratings: DataFrame, n_items: int, unique_cells: bool = False):
        doubles = ratings.filter(F.col(RATING) != 0).select(
            USER, F.col(ITEM).cast("bigint").alias(ITEM), F.col(RATING).cast("double").alias(RATING)
        )
        self.n_items = n_items
        self._tiles: dict[int, Tiles] = {}
        weakref.finalize(self, _unpersist, self._tiles).atexit = False
        self.cells = store(doubles if unique_cells else sum_duplicates(doubles), "cells").df

    @cached_property
    def facts(self) -> CellFacts:
        row = self.cells.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(USER).alias("users"),
            F.sum(RATING).alias("sum"),
            F.sum(F.col(RATING) * F.col(RATING)).alias("squares"),
        ).first()
        if not row["n"]:
            raise ValueError("the rating table is empty")
        return CellFacts(row["n"], row["users"], row["sum"] / (row["users"] * self.n_items), row["squares"])

    @cached_property
    def parts(self) -> int:
        return max(parallelism(self.cells.sparkSession), -(-self.facts.cells // RATINGS_PER_PART))

    @cached_property
    def rows(self) -> DataFrame:
        grouped = (
            self.cells.repartition(self.parts, USER)
            .groupBy(USER)
            .agg(F.collect_list(F.struct(ITEM, RATING)).alias("cells"))
            .select(USER, F.col(f"cells.{ITEM}").alias("items"), F.col(f"cells.{RATING}").alias("ratings"))
        )
        return store(grouped, "user-rows").df

    def tiles(self, rank: int) -> Tiles:
        """Tiles for vectors of this length, kept for later fits; ``release`` drops them."""
        if rank not in self._tiles:
            facts = self.facts
            least = parallelism(self.cells.sparkSession)
            self._tiles[rank] = make_tiles(self.cells, facts.users, self.n_items, facts.cells, rank, least)
        return self._tiles[rank]

    def release(self) -> None:
        """Drop the tiles from the executors' disks; they are made anew when needed."""
        _unpersist(self._tiles)

    def joined_with(self, other: RatingCells) -> RatingCells:
        """Both tables as one; users of the two sides stay different users."""
        sides = [d.cells.withColumn(USER, F.col(USER) * 2 + i) for i, d in enumerate((self, other))]
        return RatingCells(sides[0].unionByName(sides[1]), self.n_items, unique_cells=True)


def _flat(batch: pa.RecordBatch):
    """Offsets, items and ratings of a batch of user rows, as flat arrays."""
    items, ratings = batch.column("items"), batch.column("ratings")
    lengths = np.asarray(items.value_lengths())
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return (
        ends,
        items.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        ratings.flatten().to_numpy(zero_copy_only=False),
    )


def _solved_chunks(batch: pa.RecordBatch, factor: np.ndarray, gram: np.ndarray):
    """Solve the users of a batch; yields (unsettled rows, w, b, items, ratings, row of cell)."""
    ends, items, ratings = _flat(batch)
    limit = max(GATHER_DOUBLES // factor.shape[1], 1)
    row, rows = 0, len(ends) - 1
    while row < rows:
        stop = max(int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1, row + 1)
        stop = min(stop, rows)
        cells = slice(ends[row], ends[stop])
        row_of = np.repeat(np.arange(stop - row), np.diff(ends[row : stop + 1]))
        gathered = factor[items[cells]] * ratings[cells, None]
        target = np.add.reduceat(gathered, ends[row:stop] - ends[row], axis=0)
        solved, unsettled = solve_rows_counted(target, gram)
        yield unsettled, solved, target, items[cells], ratings[cells], row_of
        row = stop


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    flat = pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(pa.float64()))


def _value_columns(rank: int) -> list[str]:
    return [f"v{j}" for j in range(rank)]


def _sum_by(df: DataFrame, key: str, rank: int) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(v).alias(v) for v in _value_columns(rank)])


def _round_broadcast(rows: DataFrame, parts: int, models: list[tuple[np.ndarray, float]]) -> list[tuple]:
    """One pass over the users for all ``(item factor, regularization)``.

    For each model X'W, W'W, the sum of w.b and the number of unsettled users,
    as driver arrays; their size is that of the checked, broadcast factors.  The
    sums of all ``parts`` tasks go straight to the driver only if together they
    stay below the model limit; otherwise Spark adds them up first.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    widest = max(items.shape[1] for items, _ in models)
    names = ["model", "key", *_value_columns(widest)]

    def accumulate(batches):
        states = []
        for items, alpha in shared.value:
            size, rank = items.shape
            gram = items.T @ items + alpha * size * np.eye(rank)
            states.append([items, gram, np.zeros((size, rank)), np.zeros((rank, rank)), 0.0, 0])
        for batch in batches:
            for state in states:
                items, gram, crossed, squares = state[:4]
                size, rank = items.shape
                for open_rows, w, b, cell_items, cell_ratings, row_of in _solved_chunks(batch, items, gram):
                    squares += w.T @ w
                    state[4] += float((w * b).sum())
                    state[5] += open_rows
                    for j in range(rank):
                        crossed[:, j] += np.bincount(cell_items, cell_ratings * w[row_of, j], size)
        for number, (items, _, crossed, squares, fitted, unsettled) in enumerate(states):
            rank = items.shape[1]
            used = np.flatnonzero(crossed.any(axis=1))
            # keys: items from 0, then the rows of W'W at -1 .. -k, then two scalars
            keys = np.concatenate([used, -1 - np.arange(rank), [-1 - rank, -2 - rank]]).astype(np.int64)
            values = np.zeros((len(keys), widest))
            values[:-2, :rank] = np.vstack([crossed[used], squares])
            values[-2:, 0] = fitted, unsettled
            columns = [pa.array(np.ascontiguousarray(values[:, j])) for j in range(widest)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), pa.array(keys), *columns], names)

    schema = "model long, key long, " + ", ".join(f"{v} double" for v in _value_columns(widest))
    partials = rows.mapInArrow(accumulate, schema)
    if parts * sum((len(items) + widest + 2) * widest * 8 for items, _ in models) > MODEL_BYTES:
        partials = partials.groupBy("model", "key").agg(*[F.sum(v).alias(v) for v in _value_columns(widest)])
    sums = partials.toPandas().groupby(["model", "key"], as_index=False).sum()
    shared.destroy()
    out = []
    for number, (items, _) in enumerate(models):
        size, rank = items.shape
        own = sums[sums["model"] == number]
        keys, values = own["key"].to_numpy(), own[_value_columns(rank)].to_numpy()
        crossed, squares = np.zeros((size, rank)), np.zeros((rank, rank))
        crossed[keys[keys >= 0]] = values[keys >= 0]
        inner = (keys < 0) & (keys >= -rank)
        squares[-1 - keys[inner]] = values[inner]
        scalar = [float(values[keys == -k - rank][0, 0]) for k in (1, 2)]
        out.append((crossed, squares, scalar[0], int(scalar[1])))
    return out


def gram_matrix(df: DataFrame, column: str, normalise: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """``V'V``, column sums and number of rows of an array column; k x k on the driver."""

    def partial(batches):
        square = total = None
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if normalise:
                length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
            square = vectors.T @ vectors + (0 if square is None else square)
            total = vectors.sum(axis=0) + (0 if total is None else total)
            rows += len(vectors)
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"square": [square.ravel().tolist()], "total": [total.tolist()], "rows": [rows]}
            )

    vectors = df.select(F.col(column).cast("array<double>"))
    partials = vectors.mapInArrow(partial, "square array<double>, total array<double>, rows long")
    # k x k numbers per task, added up on the executors
    cells = partials.select(
        "rows", F.posexplode(F.concat("square", "total", F.array(F.col("rows").cast("double"))))
    )
    sums = cells.groupBy("pos").agg(F.sum("col").alias("value")).toPandas().sort_values("pos")
    if sums.empty:
        return np.zeros((0, 0)), np.zeros(0), 0
    values = sums["value"].to_numpy()
    rank = int(round((-1 + np.sqrt(1 + 4 * (len(values) - 1))) / 2))
    return values[: rank * rank].reshape(rank, rank), values[rank * rank : -1], int(values[-1])


def _solve_frame(sums: DataFrame, key: str, gram: np.ndarray, carry: list[str]) -> DataFrame:
    """``(key, embedding, fitted, unsettled, carry..)`` solved from the summed columns v0 .."""
    rank = gram.shape[0]
    kept = [key, *carry]

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            target = np.column_stack([batch.column(v).to_numpy(zero_copy_only=False) for v in _value_columns(rank)])
            w, open_rows = solve_rows_counted(target, gram)
            fitted = pa.array((w * target).sum(axis=1))
            unsettled = pa.array(np.arange(len(w)) < open_rows)  # their number is what counts
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], _lists(w), fitted, unsettled], [*kept, VECTOR, "fitted", "unsettled"]
            )

    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + f", {VECTOR} array<double>, fitted double, unsettled boolean"
    return sums.select(*kept, *_value_columns(rank)).mapInArrow(solve, schema)


@dataclass(frozen=True)
class Tiles:
    """Ratings in tiles of a user block and an item block, and each row's routes.

    ``cells`` is kept where it was dealt, on the executors' disks, sorted by
    tile; a lost part is made again from the stored ratings.  ``routes`` has for
    each user or item the other side's blocks in which it has ratings.
    """

    cells: DataFrame  # (_ub, _ib, user, item, rating)
    blocks: dict[str, int]
    routes: dict[str, DataFrame]  # by side: (user or item, _routes)
    parts: int

    def own_block(self, key: str) -> Column:
        return _block(key, self.blocks[key])

    def sums(self, factor: DataFrame, key: str, rank: int) -> DataFrame:
        """Sum of rating x vector per row of the other side.

        ``factor`` has the columns ``key``, ``_routes`` and the vector.  Rows
        without ratings on the other side are absent.
        """
        other = ITEM if key == USER else USER
        sent = factor.select(self.own_block(key), F.explode("_routes").alias(BLOCK_OF[other]), key, VECTOR)
        tile = [BLOCK_OF[USER], BLOCK_OF[ITEM]]
        sent = sent.repartition(self.parts, *tile)
        names = [other, *_value_columns(rank)]

        def multiply(ratings: pa.Table, vectors: pa.Table) -> pa.Table:
            numbers = vectors[key].to_numpy()
            order = np.argsort(numbers)
            matrix = vectors[VECTOR].combine_chunks().flatten().to_numpy().reshape(-1, rank)[order]
            at = np.searchsorted(numbers[order], ratings[key].to_numpy())
            rows, row_of = np.unique(ratings[other].to_numpy(), return_inverse=True)
            values = ratings[RATING].to_numpy()
            sums = [np.bincount(row_of, values * matrix[at, j], len(rows)) for j in range(rank)]
            return pa.Table.from_arrays([pa.array(rows), *map(pa.array, sums)], names)

        schema = ", ".join([f"{other} long", *(f"{v} double" for v in _value_columns(rank))])
        partials = self.cells.groupBy(*tile).cogroup(sent.groupBy(*tile)).applyInArrow(multiply, schema)
        return _sum_by(partials, other, rank)


    def cell_sums(self, users: DataFrame, items: DataFrame) -> dict[str, float]:
        """CELL_SUMS over all ratings for ``(user, embedding)`` and ``(item, embedding)``.

        Vectors of both sides go once to each tile that needs them; a tile hands
        on one row.
        """
        tile = [BLOCK_OF[USER], BLOCK_OF[ITEM]]

        def sent(factor: DataFrame, key: str, other: str) -> DataFrame:
            routed = factor.join(self.routes[key], key)
            return routed.select(
                self.own_block(key), F.explode("_routes").alias(BLOCK_OF[other]), F.lit(key).alias("_side"),
                F.col(key).cast("bigint").alias("_number"), VECTOR,
            )

        vectors = sent(users, USER, ITEM).unionByName(sent(items, ITEM, USER)).repartition(self.parts, *tile)

        def add_up(ratings: pa.Table, vectors: pa.Table) -> pa.Table:
            sides, sums = vectors["_side"].to_pylist(), dict.fromkeys(CELL_SUMS, 0.0)
            numbers, flat = vectors["_number"].to_numpy(), vectors[VECTOR].combine_chunks()
            matrix = flat.flatten().to_numpy().reshape(len(numbers), -1)
            found = {}
            for key in (USER, ITEM):
                mine = np.flatnonzero(np.array([s == key for s in sides]))
                order = mine[np.argsort(numbers[mine])]
                found[key] = order[np.searchsorted(numbers[order], ratings[key].to_numpy())]
            values, step = ratings[RATING].to_numpy(), max(GATHER_DOUBLES // max(matrix.shape[1], 1), 1)
            for a in range(0, len(values), step):
                w, h = (matrix[found[key][a : a + step]] for key in (USER, ITEM))
                for name, value in _cell_values(values[a : a + step], (w * h).sum(axis=1)).items():
                    sums[name] += float(value.sum())
            return pa.table({name: [total] for name, total in sums.items()})

        schema = ", ".join(f"{name} double" for name in CELL_SUMS)
        partials = self.cells.groupBy(*tile).cogroup(vectors.groupBy(*tile)).applyInArrow(add_up, schema)
        return partials.agg(*[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in CELL_SUMS]).first().asDict()


BLOCK_OF = {USER: "_ub", ITEM: "_ib"}


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(blocks)).cast("int").alias(BLOCK_OF[key])


def make_tiles(cells: DataFrame, n_users: int, n_items: int, n_cells: int, rank: int, least: int) -> Tiles:
    """Tiles of a (user, item, rating) table with unique rows; ``least`` tiles at least.

    Blocks have about BLOCK_DOUBLES numbers of vectors; more are made, on the
    side with more rows, while tiles would hold more than RATINGS_PER_TILE.
    """
    blocks = {USER: -(-n_users * rank // BLOCK_DOUBLES), ITEM: -(-n_items * rank // BLOCK_DOUBLES)}
    wanted = max(-(-n_cells // RATINGS_PER_TILE), least)
    longer, shorter = (USER, ITEM) if n_users >= n_items else (ITEM, USER)
    blocks[longer] = max(blocks[longer], -(-wanted // blocks[shorter]))
    parts = max(least, -(-n_cells // RATINGS_PER_PART))
    tile = [BLOCK_OF[USER], BLOCK_OF[ITEM]]
    block = [_block(k, n) for k, n in blocks.items()]
    dealt = cells.select(*block, F.col(USER).cast("bigint").alias(USER), ITEM, RATING)
    dealt = dealt.repartition(parts, *tile).sortWithinPartitions(*tile).persist(StorageLevel.DISK_ONLY)
    routes = {}
    for key, other in ((USER, ITEM), (ITEM, USER)):
        found = dealt.select(key, BLOCK_OF[other]).distinct().groupBy(key).agg(F.collect_list(BLOCK_OF[other]).alias("_routes"))
        routes[key] = store(found, f"{key}-routes").df
    return Tiles(dealt, blocks, routes, parts)


def _fit_joined(
    data: RatingCells, rank: int, alpha: float, iterations: int, tol: float, seed: int, given: Start | None, states: RoundStates | None
):
    """The rounds of ``fit`` with both factors as tables; nothing grows on the driver."""
    n_items, facts = data.n_items, data.facts
    n_users, squares_x = facts.users, facts.squares
    scale = float(np.sqrt(facts.mean / rank))
    tiles = data.tiles(rank)
    every_item = data.cells.sparkSession.range(n_items).select(F.col("id").alias(ITEM))
    item_rows = store(every_item.join(tiles.routes[ITEM], ITEM, "left"), "item-rows").df
    user_rows = tiles.routes[USER]

    def start(batches):
        for batch in batches:
            drawn = start_vectors(batch.column(ITEM).to_numpy(), rank, scale, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(ITEM), batch.column("_routes"), _lists(drawn)], [ITEM, "_routes", VECTOR]
            )

    saved = states.last() if states else None
    if saved:
        drawn = item_rows.join(saved[2], ITEM)
    elif given is None:
        drawn = item_rows.mapInArrow(start, f"{ITEM} long, _routes array<int>, {VECTOR} array<double>")
    else:
        drawn = item_rows.withColumn(VECTOR, given(F.col(ITEM)).cast("array<double>"))
    items = store(drawn, "items")
    losses: list[float] = list(saved[1]["losses"]) if saved else []
    for step in range(saved[0] if saved else 0, iterations + 1):
        item_gram, _, _ = gram_matrix(items.df, VECTOR)
        ridge = alpha * n_items * np.eye(rank)
        sums = tiles.sums(items.df, ITEM, rank).join(user_rows, USER)
        users = store(_solve_frame(sums, USER, item_gram + ridge, ["_routes"]), "users")
        user_gram, _, _ = gram_matrix(users.df, VECTOR)
        fitted, unsettled = users.df.agg(F.sum("fitted"), F.count_if("unsettled")).first()
        _report(unsettled, step)
        losses.append(_loss(squares_x, fitted, user_gram, item_gram, alpha, n_users, n_items))
        if step == iterations or _settled(losses, tol):
            users.discard()
            break
        # an item without ratings has only zero sums
        sums = item_rows.join(tiles.sums(users.df, USER, rank), ITEM, "left")
        sums = sums.fillna(0.0, subset=_value_columns(rank))
        new_items = store(_solve_frame(sums, ITEM, user_gram + alpha * n_users * np.eye(rank), ["_routes"]), "items")
        users.discard()
        items.discard()
        items = new_items
        if states:
            states.save(step + 1, {"losses": losses}, items.df.select(ITEM, VECTOR))
    return items.df.select(ITEM, VECTOR), losses


def _loss(squares_x, fitted, user_gram, item_gram, alpha, n_users, n_items) -> float:
    error = squares_x - 2.0 * fitted + float((user_gram * item_gram).sum())
    ridge = alpha * (n_items * np.trace(user_gram) + n_users * np.trace(item_gram))
    return 0.5 * (max(error, 0.0) + float(ridge))


def _report(unsettled: int, step: int) -> None:
    if unsettled:
        logger.warning("round %d: %d users had not settled after %d sweeps", step, unsettled, SWEEPS)


def _solve_spread(rows: DataFrame, target: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """``solve_rows`` on the driver for few rows, else on the executors."""
    if target.size <= DRIVER_SOLVE:
        return solve_rows(target, gram)
    rank = target.shape[1]
    table = pa.table({"key": np.arange(len(target)), **{v: target[:, j] for j, v in enumerate(_value_columns(rank))}})
    spread = rows.sparkSession.createDataFrame(table).repartition(parallelism(rows.sparkSession))
    solved = _solve_frame(spread, "key", gram, []).select("key", VECTOR).toArrow()  # as large as the target
    out = np.empty_like(target)
    out[solved["key"].to_numpy()] = solved[VECTOR].combine_chunks().flatten().to_numpy().reshape(-1, rank)
    return out


def _settled(losses: list[float], tol: float) -> bool:
    return len(losses) > 1 and losses[-2] - losses[-1] <= tol * max(losses[-2], 1e-30)


class Setting(NamedTuple):
    rank: int
    regularization: float
    iterations: int


def fit(
    data: RatingCells,
    rank: int,
    regularization: float = 0.0,
    iterations: int = 200,
    tol: float = 1e-4,
    seed: int = 42,
    model_bytes: int = MODEL_BYTES,
    start: Start | None = None,
    state: str | None = None,
) -> Factorization:
    """Factorize a prepared rating table.

    One Spark job per round; stops after ``iterations`` item updates or when
    the loss falls by less than ``tol`` of itself (a negative ``tol`` never
    stops).  ``start`` maps the item number to its first vector; without it the
    vectors are random.  Users whose vector had not settled are logged.
    ``state``: a folder for the state of each round; a fit that was stopped goes
    on from its last whole round when it is called again with the same data,
    settings and folder, and ends with the same numbers.
    """
    return fit_settings(data, [Setting(rank, regularization, iterations)], tol, seed, model_bytes, start, state=state)[0]


def fit_settings(
    data: RatingCells,
    settings: list[Setting],
    tol: float = 1e-4,
    seed: int = 42,
    model_bytes: int = MODEL_BYTES,
    start: Start | None = None,
    workers: int = 1,
    state: str | None = None,
) -> list[Factorization]:
    """``fit`` for each setting, with the numbers it has alone.

    One pass over the users per round serves all settings whose item factors
    together may be broadcast, and settings that differ only in their number of
    rounds are one model, taken at several rounds.  So the jobs grow with the
    rounds, not with the settings.  Models that are too large to broadcast are
    fitted one by one, ``workers`` at a time.
    """
    chains = list(dict.fromkeys((s.rank, s.regularization) for s in settings))
    rounds = {c: sorted({s.iterations for s in settings if s[:2] == c}) for c in chains}
    found: dict[Setting, Factorization] = {}
    waves: list[list[tuple[int, float]]] = []
    held = 0
    for chain in chains:
        size = data.n_items * chain[0] * 8
        if size <= model_bytes:
            if not waves or held + size > model_bytes:
                waves.append([])
                held = 0
            waves[-1].append(chain)
            held += size

    def states(name: str, fitted: list) -> RoundStates | None:
        if state is None:
            return None
        facts = data.facts
        squares = float(f"{facts.squares:.9g}")  # its last digits follow the order of the rows
        about = [data.n_items, facts.users, facts.cells, squares, tol, seed]
        identity = dict(zip(("items", "users", "cells", "squares", "tol", "seed"), about, strict=True)) | {"fitted": fitted}
        return RoundStates(data.cells.sparkSession, f"{state}/{name}", identity)

    for number, wave in enumerate(waves):
        of_wave = states(f"wave-{number}", [[*c, rounds[c]] for c in wave])
        found |= _fit_wave(data, wave, rounds, tol, seed, start, of_wave)

    def alone(setting: Setting) -> Factorization:
        own = states("-".join(map(str, setting)), list(setting))
        items, losses = _fit_joined(data, *setting[:2], setting.iterations, tol, seed, start, own)
        return Factorization(items, *setting[:2], losses)

    large = [s for s in dict.fromkeys(settings) if s not in found]
    for rank in {s.rank for s in large}:
        data.tiles(rank)  # made once, before the threads start
    with ThreadPoolExecutor(max_workers=max(workers, 1)) as pool:
        found |= dict(zip(large, pool.map(alone, large), strict=True))
    return [found[s] for s in settings]


def _fit_wave(
    data: RatingCells, wave: list[tuple[int, float]], rounds: dict, tol: float, seed: int, start: Start | None, states: RoundStates | None
) -> dict:
    """Models of all ``(rank, regularization)`` of a wave, taken at their ``rounds``."""
    n_items, facts, rows = data.n_items, data.facts, data.rows
    n_users, squares_x, spark = facts.users, facts.squares, data.cells.sparkSession
    if start is None:
        factors = {c: start_vectors(np.arange(n_items), c[0], float(np.sqrt(facts.mean / c[0])), seed) for c in wave}
    else:
        numbers = spark.range(n_items).select("id", start(F.col("id")).cast("array<double>").alias("v"))
        given = np.array(numbers.toArrow().sort_by("id")["v"].to_pylist(), np.float64)  # the checked model size
        factors = {c: given for c in wave}
    losses: dict[tuple, list[float]] = {c: [] for c in wave}
    found: dict[Setting, Factorization] = {}
    active, step = list(wave), 0

    def table_of(items: np.ndarray) -> pa.Table:
        return pa.table({ITEM: np.arange(n_items), VECTOR: _lists(items)})  # the checked model size

    def taken_at(chain: tuple, t: int, items: np.ndarray) -> dict:
        model = Factorization(spark.createDataFrame(table_of(items)), *chain, losses[chain][: t + 1], items)
        return {Setting(*chain, t): model}

    saved = states.last() if states else None
    if saved:
        step, noted, table = saved
        losses = dict(zip(wave, noted["losses"], strict=True))
        active = [wave[k] for k in noted["active"]]
        local = table.toArrow().sort_by([("chain", "ascending"), ("taken", "ascending"), (ITEM, "ascending")])
        numbers, times = local["chain"].to_numpy(), local["taken"].to_numpy()
        for k, t in sorted(set(zip(numbers.tolist(), times.tolist()))):
            own = local.filter(pa.array((numbers == k) & (times == t)))
            items = np.array(own[VECTOR].to_pylist(), np.float64)
            if t < 0:
                factors[wave[k]] = items
            else:
                found |= taken_at(wave[k], t, items)

    def save() -> None:
        parts = [(k, -1, factors[c]) for k, c in enumerate(wave) if c in active]
        parts += [(wave.index(s[:2]), s.iterations, m.factor) for s, m in found.items()]
        marked = [
            table_of(items).append_column("chain", pa.array(np.full(n_items, k))).append_column("taken", pa.array(np.full(n_items, t)))
            for k, t, items in parts
        ]
        noted = {"losses": [losses[c] for c in wave], "active": [wave.index(c) for c in active]}
        states.save(step, noted, spark.createDataFrame(pa.concat_tables(marked)))

    while active:
        passed = _round_broadcast(rows, data.parts, [(factors[c], c[1]) for c in active])
        for chain, (crossed, user_gram, fitted, unsettled) in zip(list(active), passed, strict=True):
            items, alpha = factors[chain], chain[1]
            _report(unsettled, step)
            losses[chain].append(_loss(squares_x, fitted, user_gram, items.T @ items, alpha, n_users, n_items))
            settled = _settled(losses[chain], tol)
            taken = [t for t in rounds[chain] if t == step or (settled and t > step)]
            for t in taken:
                found |= taken_at(chain, t, items)
            if settled or step == rounds[chain][-1]:
                active.remove(chain)
            else:
                factors[chain] = _solve_spread(rows, crossed, user_gram + alpha * n_users * np.eye(chain[0]))
        step += 1
        if states:
            save()
    return found


def fold_in(
    data: RatingCells, items: DataFrame, regularization: float = 0.0, model_bytes: int = MODEL_BYTES
) -> DataFrame:
    """``(user, embedding)``: non-negative user vectors for fixed item vectors."""
    n_items = data.n_items
    item_gram, _, _ = gram_matrix(items, VECTOR)
    rank = item_gram.shape[0]
    gram = item_gram + regularization * n_items * np.eye(rank)
    if n_items * rank * 8 > model_bytes:
        tiles = data.tiles(rank)
        sums = tiles.sums(items.join(tiles.routes[ITEM], ITEM), ITEM, rank)
        return _solve_frame(sums, USER, gram, []).select(USER, VECTOR)
    local = items.toPandas()  # below the checked model size
    factor = np.zeros((n_items, rank))
    factor[local[ITEM].to_numpy()] = np.array(local[VECTOR].tolist())
    rows = data.rows
    shared = rows.sparkSession.sparkContext.broadcast(factor)

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = np.vstack([chunk[1] for chunk in _solved_chunks(batch, shared.value, gram)])
            yield pa.RecordBatch.from_arrays([batch.column(USER), _lists(w)], [USER, VECTOR])

    user_type = rows.schema[USER].dataType.simpleString()
    return rows.mapInArrow(solve, f"{USER} {user_type}, {VECTOR} array<double>")


def similarity_variance(items: DataFrame, column: str = VECTOR) -> float:
    """Population variance of the cosines of all item pairs, self pairs included.

    From the sum and the Gram matrix of the unit vectors; the item x item
    matrix is never built.
    """
    return _variance(*gram_matrix(items, column, normalise=True))


def _variance(gram: np.ndarray, total: np.ndarray, rows: int) -> float:
    if not rows:
        return float("nan")
    mean = float(total @ total) / rows**2
    return float((gram * gram).sum()) / rows**2 - mean**2


# Metric names in the order they are reported.
METRICS = (
    "MAE",
    "MAE_active",
    "MAE_inactive",
    "MSE",
    "MSE_active",
    "MSE_inactive",
    "active_features",
    "inactive_features",
    "similarity_variance",
)
METRIC_SCHEMA = "metric string, value double, dataset string"


def factor_metrics(
    ratings: DataFrame,
    users: DataFrame,
    items: DataFrame,
    dataset: str = "test",
    legacy_inactive: bool = False,
    n_users: int | None = None,
) -> DataFrame:
    """``(metric, value, dataset)`` of W H against the rating table.

    ``ratings`` has one row per cell.  Means over all user x item cells come
    from the stored cells plus W'W, H'H and the column sums, so the full matrix
    is never built; this needs W, H >= 0.  Active cells are non-zero, inactive
    cells zero (``legacy_inactive``: different from 1).  ``n_users`` overrides
    the number of matrix rows.
    """
    user_gram, user_sum, user_rows = gram_matrix(users, VECTOR)
    x, y = F.col("x"), F.col("y")
    cells = (
        ratings.filter(F.col(RATING) != 0)
        .join(items.select(ITEM, F.col(VECTOR).alias("_h")), ITEM)
        .join(users.select(USER, F.col(VECTOR).alias("_w")), USER)
        .select(F.col(RATING).cast("double").alias("x"), dot(F.col("_w"), F.col("_h")).alias("y"))
    )
    other = F.col("x") != 1
    sums = {
        "n": F.lit(1.0),
        "xx": x * x,
        "xy": x * y,
        "yy": y * y,
        "y": y,
        "sse": (x - y) * (x - y),
        "sae": F.abs(x - y),
        "n_other": F.when(other, 1.0).otherwise(0.0),
        "sse_other": F.when(other, (x - y) * (x - y)).otherwise(0.0),
        "sae_other": F.when(other, F.abs(x - y)).otherwise(0.0),
    }
    s = cells.agg(*[F.coalesce(F.sum(sums[name]), F.lit(0.0)).alias(name) for name in CELL_SUMS]).first().asDict()
    rows = user_rows if n_users is None else n_users
    item_sums, variance = gram_matrix(items, VECTOR), similarity_variance(items)
    return _metrics_table(ratings.sparkSession, s, user_gram, user_sum, rows, item_sums, variance, dataset, legacy_inactive)


# Sums over the stored cells that the metrics need.
CELL_SUMS = ("n", "xx", "xy", "yy", "y", "sse", "sae", "n_other", "sse_other", "sae_other")


def _cell_values(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """What CELL_SUMS add up, for ratings ``x`` and their estimates ``y``."""
    error, other = x - y, x != 1
    squares, sizes = error * error, np.abs(error)
    values = np.ones(len(x)), x * x, x * y, y * y, y, squares, sizes, other, squares[other], sizes[other]
    return dict(zip(CELL_SUMS, values, strict=True))


def fold_in_metrics(
    data: RatingCells,
    items: DataFrame,
    regularization: float = 0.0,
    dataset: str = "test",
    legacy_inactive: bool = False,
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """``factor_metrics`` of the users folded in for ``items``.

    While the item factor may be broadcast, one pass over the user rows solves
    the users and adds up the errors of their cells: no vector is shuffled or
    written.  Beyond, users are stored, and the vectors of both sides go once to
    each tile of ratings.
    """
    rank = gram_matrix(items, VECTOR)[0].shape[0]
    if data.n_items * rank * 8 > model_bytes:
        users = store(fold_in(data, items, regularization, model_bytes), "users")
        own = data.tiles(rank).cell_sums(users.df, items), *gram_matrix(users.df, VECTOR)
        users.discard()
        item_sums, variance = gram_matrix(items, VECTOR), similarity_variance(items)
        return _metrics_table(data.cells.sparkSession, *own, item_sums, variance, dataset, legacy_inactive)
    local = items.toPandas()  # below the checked model size
    factor = np.zeros((data.n_items, rank))
    factor[local[ITEM].to_numpy()] = np.array(local[VECTOR].tolist())
    sums = _fold_in_sums(data, [(factor, regularization)])[0]
    return _metrics_table(data.cells.sparkSession, *sums, gram_matrix(items, VECTOR), similarity_variance(items), dataset, legacy_inactive)


def _fold_in_sums(data: RatingCells, models: list[tuple[np.ndarray, float]]) -> list[tuple[dict, np.ndarray, np.ndarray, int]]:
    """Per ``(item factor, regularization)`` the cells' sums, W'W, the sum of w and the users, in one pass."""
    rows = data.rows
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def add_up(batches):
        states = []
        for factor, alpha in shared.value:
            size, rank = factor.shape
            gram = factor.T @ factor + alpha * size * np.eye(rank)
            states.append([factor, gram, dict.fromkeys(CELL_SUMS, 0.0), np.zeros((rank, rank)), np.zeros(rank), 0])
        for batch in batches:
            for state in states:
                factor, gram, s, squares, total, _ = state
                for _, w, _, cell_items, x, row_of in _solved_chunks(batch, factor, gram):
                    y = (w[row_of] * factor[cell_items]).sum(axis=1)
                    for name, value in _cell_values(x, y).items():
                        s[name] += float(value.sum())
                    squares += w.T @ w
                    total += w.sum(axis=0)
                    state[5] += len(w)
        for number, (_, _, s, squares, total, users) in enumerate(states):
            if users:
                values = np.array([*s.values(), users, *total, *squares.ravel()], np.float64)
                columns = [pa.array(np.full(len(values), number)), pa.array(np.arange(len(values))), pa.array(values)]
                yield pa.RecordBatch.from_arrays(columns, ["model", "at", "value"])

    parts = rows.mapInArrow(add_up, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value"))
    table = parts.toPandas().sort_values(["model", "at"])
    shared.destroy()
    out = []
    for number, (factor, _) in enumerate(models):
        rank = factor.shape[1]
        values = table.loc[table["model"] == number, "value"].to_numpy()
        if not len(values):
            values = np.zeros(len(CELL_SUMS) + 1 + rank + rank * rank)
        rest = values[len(CELL_SUMS) :]
        s = dict(zip(CELL_SUMS, values.tolist(), strict=False))
        out.append((s, rest[1 + rank :].reshape(rank, rank), rest[1 : 1 + rank], int(rest[0])))
    return out


def _metrics_table(
    spark, s: dict, user_gram: np.ndarray, user_sum: np.ndarray, rows: int,
    item_sums: tuple[np.ndarray, np.ndarray, int], variance: float, dataset: str, legacy_inactive: bool,
) -> DataFrame:
    item_gram, item_sum, n_items = item_sums
    if rows == 0 or n_items == 0:
        logger.warning("no metrics for empty dataset %s", dataset)
        return spark.createDataFrame([], METRIC_SCHEMA)
    y_squares, y_total = float((user_gram * item_gram).sum()), float(user_sum @ item_sum)
    all_cells = rows * n_items
    zero_cells = all_cells - s["n"]
    zero_sse, zero_sae = max(y_squares - s["yy"], 0.0), max(y_total - s["y"], 0.0)
    inactive, inactive_sse, inactive_sae = zero_cells, zero_sse, zero_sae
    if legacy_inactive:
        inactive += s["n_other"]
        inactive_sse += s["sse_other"]
        inactive_sae += s["sae_other"]

    def mean(total: float, count: float) -> float:
        return total / count if count else float("nan")

    values = (
        mean(s["sae"] + zero_sae, all_cells),
        mean(s["sae"], s["n"]),
        mean(inactive_sae, inactive),
        mean(max(s["xx"] - 2 * s["xy"] + y_squares, 0.0), all_cells),
        mean(s["sse"], s["n"]),
        mean(inactive_sse, inactive),
        float(s["n"]),
        float(inactive),
        variance,
    )
    return spark.createDataFrame([(m, v, dataset) for m, v in zip(METRICS, values)], METRIC_SCHEMA)


def performance_score(metrics: DataFrame, measure: str = "MSE") -> float:
    """Score to maximise: ``1 / (1 + MSE)`` or the similarity variance; 0 without metrics."""
    if measure not in ("MSE", "similarity_variance"):
        raise ValueError(f"unsupported measure: {measure}")
    row = metrics.filter(F.col("metric") == measure).first()
    if row is None:
        return 0.0
    return 1.0 / (1.0 + row["value"]) if measure == "MSE" else row["value"]


# One row per tried setting.
SCORE_SCHEMA = "embedding_size int, regularization double, max_iterations int, score double"


@dataclass
class GridResult:
    items: DataFrame
    metrics: DataFrame
    scores: DataFrame  # (embedding_size, regularization, max_iterations, score)
    best: tuple[int, float, int]


def _all_metrics(data: RatingCells, settings: list[Setting], models: list[Factorization], model_bytes: int):
    """``(setting, metrics)`` of all models; those on the driver go through the users together."""
    small = [(s, m.factor) for s, m in zip(settings, models, strict=True) if m.factor is not None]
    while small:
        wave, held = [], 0
        while small and (not wave or held + small[0][1].nbytes <= model_bytes):
            wave.append(small.pop(0))
            held += wave[-1][1].nbytes
        sums = _fold_in_sums(data, [(factor, s.regularization) for s, factor in wave])
        for (setting, factor), own in zip(wave, sums, strict=True):
            length = np.sqrt((factor * factor).sum(axis=1, keepdims=True))
            unit = np.divide(factor, length, out=np.zeros_like(factor), where=length > 0)
            variance = _variance(unit.T @ unit, unit.sum(axis=0), len(unit))
            item_sums = factor.T @ factor, factor.sum(axis=0), len(factor)
            yield setting, _metrics_table(data.cells.sparkSession, *own, item_sums, variance, "test", False)
    for setting, model in zip(settings, models, strict=True):
        if model.factor is None:
            yield setting, fold_in_metrics(data, model.items, setting.regularization, model_bytes=model_bytes)


def grid_search(
    train: DataFrame,
    test: DataFrame,
    n_items: int,
    sizes: list[int],
    regularizations: list[float],
    iterations: list[int],
    measure: str = "MSE",
    workers: int = 1,
    seed: int = 42,
    tol: float = 1e-4,
    model_bytes: int = MODEL_BYTES,
    unique_cells: bool = False,
    start: Start | None = None,
    state: str | None = None,
) -> GridResult:
    """Fit every setting on ``train``, score it on ``test``, refit the best on both.

    The first setting with the highest score wins.  Settings are fitted and
    scored together (``fit_settings``); those too large to broadcast share the
    cluster ``workers`` at a time.  ``unique_cells`` says that no (user, item)
    repeats.  ``state``: a folder for the rounds of all fits, as in ``fit``.
    """
    spark = train.sparkSession
    train_data = RatingCells(train, n_items, unique_cells)
    test_data = RatingCells(test, n_items, unique_cells)

    settings = [Setting(*s) for s in product(sizes, regularizations, iterations)]
    states = (f"{state}/grid", f"{state}/best") if state else (None, None)
    models = fit_settings(train_data, settings, tol, seed, model_bytes, start, workers, states[0])
    tables = dict(_all_metrics(test_data, settings, models, model_bytes))
    attempts = [(s, tables[s], performance_score(tables[s], measure)) for s in settings]
    usable = [a for a in attempts if not np.isnan(a[2])]
    if not usable:
        raise ValueError("no setting gave a usable score; check the ratings for NaN")
    best = max(usable, key=lambda a: a[2])  # the first of equal scores
    both = train_data.joined_with(test_data)
    size, regularization, rounds = best[0]
    model = fit(both, size, regularization, rounds, tol, seed, model_bytes, start, states[1])
    for data in (train_data, test_data, both):
        data.release()
    scores = spark.createDataFrame([(*s, float(v)) for s, _, v in attempts], SCORE_SCHEMA)
    return GridResult(model.items, best[1], scores, best[0])
