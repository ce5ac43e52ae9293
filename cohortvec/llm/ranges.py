"""Consecutive ranges of an integer id with bounded bytes of text, as block numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that count as one unit of weight.
UNIT = 4096


def range_bounds(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[int]:
    """Ids at which new blocks begin, so that a block holds about ``block_bytes``.

    An id with more than that makes its block larger, as null ids make block 0.
    """
    return sorted(set(range_cuts(docs, id_col, text_col, block_bytes)[0]))


def range_cuts(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[list[int], int]:
    """Sorted quantiles of the ids about ``block_bytes`` apart, and the bytes under null.

    An id that fills a block is there more than once.  Two jobs over all rows;
    one number per block reaches the driver.  Every row weighs at least one
    unit, so blocks of short texts hold fewer bytes.
    """
    units = F.greatest(F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / F.lit(UNIT)), F.lit(1)).cast("int")
    unnamed = F.col(id_col).isNull()
    sums = docs.agg(F.sum(F.when(~unnamed, units)).alias("n"), F.sum(F.when(unnamed, units)).alias("nulls")).first()
    null_bytes = (sums["nulls"] or 0) * UNIT
    blocks = math.ceil((sums["n"] or 0) * UNIT / block_bytes)
    if blocks <= 1:
        return [], null_bytes
    weighted = docs.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(1), units)))
    cuts = [i / blocks for i in range(1, blocks)]
    found = weighted.agg(
        F.percentile_approx("id", cuts, max(10_000, min(10 * blocks, 10_000_000))).alias("cuts")
    ).first()["cuts"]
    return sorted(found or []), null_bytes


def range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (null: 0).

    Two short searches instead of one long: the first finds a run of bounds,
    the second the place in it.
    """
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    def column(v: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")

    runs = F.size(F.filter(column(bounds[::step]), lambda b: b <= value))
    inside = F.slice(column(bounds), (runs - 1) * step + 1, F.lit(step))
    found = (runs - 1) * step + F.size(F.filter(inside, lambda b: b <= value))
    return F.when(runs > 0, found).otherwise(0)
