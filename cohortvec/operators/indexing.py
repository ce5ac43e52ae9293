"""Dense 0-based indexes over sorted keys, and joins that use them.

No single-partition window and no driver collect of keys: keys are range
partitioned, numbered inside their partition and shifted by the sizes of the
partitions before.  Only one row per range partition reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store

# Fixed value: monotonically_increasing_id keeps the row number of a partition
# in its low 33 bits and the partition number above them.
ROW_BITS = 33

# An index is broadcast only below this measured size.
BROADCAST_BYTES = 64 * 1024 * 1024

# Bytes a row takes in a broadcast table besides its text: row, keys, hash slot.
ROW_BYTES = 96

# A key is hot when it holds more rows than one task should take, whatever the
# number of all rows; its pieces hold about as many.
PIECE_ROWS = 2_000_000
# Hot keys number at most all rows / PIECE_ROWS; beyond this they are not broadcast.
HOT_KEYS = 500_000


@dataclass(frozen=True)
class KeyIndex:
    """Index table plus the sizes measured while it was built."""

    table: DataFrame  # (key, index, _rows)
    key: str
    index: str
    keys: int
    rows: int
    bytes: int

    @property
    def pairs(self) -> DataFrame:
        return self.table.select(self.key, self.index)


def build_key_index(df: DataFrame, key: str, index: str) -> KeyIndex:
    """Index the distinct values of ``key`` in ascending order, from 0.

    Runs jobs: the numbered keys are written to the shared folder, so that
    both later passes see the same range partitions.
    """
    placed = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    table = store(placed, f"index-{index}").df
    text_bytes = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
    blocks = (
        table.groupBy(F.shiftright("_slot", ROW_BITS).cast("int").alias("block"))
        .agg(
            F.count(F.lit(1)).alias("keys"),
            F.sum("_rows").alias("rows"),
            F.sum(text_bytes + ROW_BYTES).alias("bytes"),
        )
        .collect()
    )  # one row per range partition
    starts = [0] * (max((b["block"] for b in blocks), default=0) + 1)
    keys = 0
    for b in sorted(blocks, key=lambda b: b["block"]):
        starts[b["block"]] = keys
        keys += b["keys"]
    position = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # one literal whatever the number of partitions: folded before the scan
    per_block = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    start = F.get(per_block, F.shiftright("_slot", ROW_BITS).cast("int"))
    indexed = table.select(key, (start + position).alias(index), "_rows")
    return KeyIndex(
        indexed, key, index, keys, sum(b["rows"] for b in blocks), sum(b["bytes"] for b in blocks)
    )


def dense_index(df: DataFrame, key: str, index: str) -> DataFrame:
    """``(key, index)`` over the sorted distinct keys of ``df``."""
    return build_key_index(df, key, index).pairs


def attach_index(
    facts: DataFrame, index: KeyIndex, spread: list[str], broadcast_bytes: int | None = None
) -> DataFrame:
    """Inner join of ``facts`` with an index built over the same rows.

    A small index (size measured at build time) is broadcast.  Otherwise both
    sides shuffle, and each hot key is cut into pieces by a hash of the
    ``spread`` columns, with one copy of its index row per piece.
    """
    if index.bytes <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return facts.join(F.broadcast(index.pairs), index.key)
    return salted_join(facts, index.table, index.key, index.rows, spread)


def hot_side(hot: DataFrame, total: int) -> DataFrame:
    """Hot keys as join side: broadcast while ``total`` rows cannot have too many."""
    return F.broadcast(hot) if total // PIECE_ROWS <= HOT_KEYS else hot


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, total: int, spread: list[str]) -> DataFrame:
    """Inner shuffle join of ``facts`` with one row per key; hot keys are cut.

    ``lookup`` carries ``_rows``, the key's number of rows in ``facts``, and
    ``total`` is their sum.  A key of more than PIECE_ROWS rows is cut into
    pieces by a hash of the ``spread`` columns, with one copy of its lookup row
    per piece.
    """
    if total <= PIECE_ROWS:  # no key can be hot
        return facts.join(lookup.drop("_rows"), key)
    pieces = F.ceil(F.col("_rows") / F.lit(PIECE_ROWS)).cast("int")
    is_hot = F.col("_rows") > F.lit(PIECE_ROWS)
    hot = lookup.filter(is_hot).select(key, pieces.alias("_pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_pieces")), F.lit(0)).cast("int")
    cut = facts.join(hot_side(hot, total), key, "left").withColumn("_piece", piece).drop("_pieces")
    copies = lookup.select(
        *[c for c in lookup.columns if c != "_rows"],
        F.explode(F.sequence(F.lit(0), F.when(is_hot, pieces - 1).otherwise(F.lit(0)))).alias("_piece"),
    )
    return cut.join(copies, [key, "_piece"]).drop("_piece")
