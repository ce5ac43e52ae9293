"""Exact deduplication through counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit fingerprints
of its texts: the high bits of a fingerprint (quotient) name a run, the rest
(remainder) is kept sorted in it with a count.  Filters of the same shape merge
without loss by merging sorted remainders.  Only fingerprints counted more than
once go on to a comparison of the texts themselves, so a collision of
fingerprints costs work but never joins two different texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import join_counted, store_counted
from .words import U64, from_planes, planes

# Fingerprints in one merged part, and quotients (runs) of a part as a power of two.
PART_ROWS = 1 << 20
RUN_BITS = 10
# Fingerprints a task gathers before it hands out a filter.
TASK_ROWS = 1 << 22


@dataclass(frozen=True)
class CountingQuotientFilter:
    """Fingerprints that share their first ``prefix_bits``, with counts."""

    prefix: int
    prefix_bits: int
    runs: np.ndarray  # remainders in each run, 2**RUN_BITS numbers
    remainders: np.ndarray  # sorted within a run, no remainder twice
    counts: np.ndarray

    @classmethod
    def of(cls, prefix: int, prefix_bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From sorted distinct fingerprints of this prefix."""
        rest = U64(64 - prefix_bits - RUN_BITS)
        quotient = (fingerprints >> rest) & U64((1 << RUN_BITS) - 1)
        runs = np.bincount(quotient.astype(np.int64), minlength=1 << RUN_BITS).astype(np.int64)
        return cls(prefix, prefix_bits, runs, fingerprints & U64((1 << int(rest)) - 1), counts)

    @property
    def fingerprints(self) -> np.ndarray:
        rest = U64(64 - self.prefix_bits - RUN_BITS)
        quotient = np.repeat(np.arange(1 << RUN_BITS, dtype=U64), self.runs) << rest
        return (U64(self.prefix) << U64(64 - self.prefix_bits)) | quotient | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        together = np.concatenate([f.fingerprints for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(together, kind="stable")
        distinct, first = np.unique(together[order], return_index=True)
        summed = np.add.reduceat(counts[order], first) if len(first) else counts
        return cls.of(filters[0].prefix, filters[0].prefix_bits, distinct, summed)

    def repeated(self) -> np.ndarray:
        return self.fingerprints[self.counts > 1]


PARTS = "prefix bigint, runs binary, remainders binary, counts binary"


def _filters(prefix_bits: int):
    def handed(fingerprints: np.ndarray) -> pa.RecordBatch:
        distinct, counts = np.unique(fingerprints, return_counts=True)
        edges = np.arange(1, 1 << prefix_bits, dtype=U64) << U64(64 - prefix_bits)
        cuts = [0, *np.searchsorted(distinct, edges), len(distinct)]
        own = [
            CountingQuotientFilter.of(p, prefix_bits, distinct[a:b], counts[a:b])
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if a < b
        ]
        columns = [
            pa.array([f.prefix for f in own], pa.int64()),
            pa.array([f.runs.astype("<i4").tobytes() for f in own], pa.binary()),
            pa.array([planes(f.remainders) for f in own], pa.binary()),
            pa.array([f.counts.astype("<i8").tobytes() for f in own], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["prefix", "runs", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(np.asarray(batch.column(0)).view(U64))
            rows += batch.num_rows
            if rows >= TASK_ROWS:
                yield handed(np.concatenate(waiting))
                waiting, rows = [], 0
        if rows:
            yield handed(np.concatenate(waiting))

    return run


def _repeated(prefix_bits: int):
    def run(table: pa.Table) -> pa.Table:
        filters = [
            CountingQuotientFilter(
                row["prefix"],
                prefix_bits,
                np.frombuffer(row["runs"], "<i4"),
                from_planes(row["remainders"]),
                np.frombuffer(row["counts"], "<i8"),
            )
            for row in table.to_pylist()
        ]
        found = CountingQuotientFilter.merge(filters).repeated()
        return pa.table({"fingerprint": pa.array(found.view(np.int64))})

    return run


def repeated_fingerprints(rows: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Fingerprints (bigint, no nulls) that ``rows`` hold more than once."""
    total = rows.count()
    prefix_bits = min(max(math.ceil(math.log2(max(total / PART_ROWS, 1))), 4), 24)
    parts = rows.select(fingerprint).mapInArrow(_filters(prefix_bits), PARTS)
    return parts.groupBy("prefix").applyInArrow(_repeated(prefix_bits), "fingerprint bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical byte by byte; null counts as empty.  Of equal
    texts the row with the largest id stays; a null id is smaller than any
    other.  Rows that repeat an id and a text all count, and all are kept if
    their id is.  Other columns are not looked at.  Runs jobs: the repeated
    fingerprints and the groups of equal texts are written to the shared folder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text"))
    suspects, n = store_counted(repeated_fingerprints(rows), "repeated-fingerprints")
    # grouping by the text itself is the byte comparison; copies in one task
    # become one row before the shuffle
    equal = (
        join_counted(rows, suspects, n, ["fingerprint"], "left_semi")
        .groupBy("fingerprint", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > 1)
        .select("fingerprint", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups, n = store_counted(equal, "equal-texts")
    hashed = rows.select("doc_id", "fingerprint", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    grouped = F.col("group_size").isNotNull()
    return join_counted(hashed, groups, n, ["fingerprint", "text_sha256"], "left").select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (~grouped | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
