"""Substring deduplication over fixed-length word windows.

Every window of ``window`` words gets a Rabin-Karp hash.  Texts are dealt once
into blocks of consecutive ids, an id with more than a block into several in the
order of its texts; each block sends its distinct hashes, sorted, to
hash ranges, where Spark brings equal ones together.  A hash that an earlier
block also holds sets one bit that travels back to its block, so no position is
ever shuffled: within a block the task knows the order itself.  Repeated windows
then merge into maximal removal intervals.

Hashes have 64 bits: two different windows are taken for equal with probability
2**-64, so N distinct windows give N*N / 2**65 wrong pairs (6e-4 at 145 million
windows).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .ranges import UNIT, range_cuts, range_number
from .sizes import bound_batches, join_counted
from .words import U64, Words, from_planes, groups_of_rows, planes, rolling, split_words, window_starts

BLOCK_BYTES = 4 << 20
# First characters of a text by which the rows of one id are dealt to be sorted.
PREFIX = 128
# Windows that one hash range holds on average, and bytes of text per window.
RANGE_WINDOWS = 1 << 21
WINDOW_BYTES = 6

SCHEMA = (
    "doc_id bigint, n_words bigint, n_removed bigint, "
    "removed array<struct<start:bigint,end:bigint>>, kept_text string"
)


def remove_repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    block_bytes: int = BLOCK_BYTES,
    range_windows: int = RANGE_WINDOWS,
) -> DataFrame:
    """One row per document: its words, the removed intervals and the kept text.

    A word goes when a window that covers it also starts earlier: in a document
    with a smaller id, or before in the same document.  All windows are judged
    on the input.  Intervals are maximal, in words, end excluded.

    Null or empty text: no words, empty kept text.  Fewer words than a window:
    nothing removed.  Rows that share an id come in the order of their texts; a
    null id comes first.  Repeated rows are documents of their own: all but one
    lose every word that a window covers.  Other columns are not looked at.
    Runs two jobs for the sizes; the rest is lazy, unless an id or null holds more
    than a block: then its rows are sorted and written to the shared folder.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    blocks, n_blocks = blocks_of_rows(rows, block_bytes)
    spark = docs.sparkSession
    # a task gets a few whole blocks; at least the session's number, so that
    # the planner keeps this dealing for both uses below
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_blocks / 4))
    dealt = blocks.repartition(tasks, "block")
    total = n_blocks * block_bytes // WINDOW_BYTES
    bits = min(max(math.ceil(math.log2(max(total / range_windows, 1))), 4), 20)

    hashes = dealt.mapInArrow(_hashes_of_blocks(window, bits), "block int, bucket int, hashes binary")
    earlier = hashes.groupBy("bucket").applyInArrow(_held_earlier, "block int, bucket int, held binary")
    return dealt.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(_cut(window, bits), SCHEMA)


def blocks_of_rows(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``doc_id, text, block`` and how many blocks; blocks follow the order of id and text.

    A block holds a few times ``block_bytes`` at most, or one row, whatever
    number of rows share an id.  Rows of an id that fills a block, or of null, are
    sorted by Spark and cut while they stream through a task.
    """
    cuts, null_bytes = range_cuts(rows, "doc_id", "text", block_bytes)
    bounds = sorted(set(cuts))
    number = range_number(F.col("doc_id"), bounds)
    shared = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    if not shared and null_bytes <= block_bytes:
        return rows.withColumn("block", number.cast("int")), len(bounds) + 1
    spark = rows.sparkSession
    apart = F.coalesce(F.col("doc_id").isin(shared), F.lit(null_bytes > block_bytes))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.filter(apart)
        .repartitionByRange(tasks, "doc_id", F.substring("text", 1, PREFIX))
        .sortWithinPartitions("doc_id", "text")
    )
    pieces = store(ordered.mapInArrow(_pieces(block_bytes), "doc_id bigint, text string, part int, piece int"), "shared-ids").df
    # pieces of an id come before the block that it begins, those of null first
    places: list[tuple] = [((i, 1), None) for i in range(len(bounds) + 1)]
    for r in pieces.select("doc_id", "part", "piece").distinct().collect():
        at = 0 if r["doc_id"] is None else bisect_right(bounds, r["doc_id"])
        places.append(((at, 0, r["part"], r["piece"]), (r["part"], r["piece"])))
    places.sort(key=lambda p: p[0])
    plain = ",".join(str(k) for k, (_, piece) in enumerate(places) if piece is None)
    others = rows.filter(~apart).withColumn("block", F.get(F.split(F.lit(plain), ",").cast("array<int>"), number.cast("int")))
    numbered = [(*piece, k) for k, (_, piece) in enumerate(places) if piece is not None]
    numbers = spark.createDataFrame(numbered, "part int, piece int, block int")
    cut = join_counted(pieces, numbers, len(numbered), ["part", "piece"])
    return others.unionByName(cut.select("doc_id", "text", "block")), len(places)


def _pieces(block_bytes: int):
    """Numbers consecutive rows of an id, as many as a block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, held, last = -1, 0, None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            pieces = []
            for doc_id, n in zip(ids.to_pylist(), pc.binary_length(texts).to_pylist(), strict=True):
                weight = max(-(-(n or 0) // UNIT), 1) * UNIT
                if piece < 0 or doc_id != last or held + weight > block_bytes:
                    piece, held, last = piece + 1, 0, doc_id
                held += weight
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays(
                [ids, texts, pa.array([part] * len(ids), pa.int32()), pa.array(pieces, pa.int32())],
                ["doc_id", "text", "part", "piece"],
            )

    return run


def _bucket_edges(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)


def _hashes_of_blocks(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part in groups_of_rows(batch, "text"):
                words = split_words(part.column("text"))
                at = window_starts(words, window)
                hashes = rolling(words.hash, window)[at]
                of = np.asarray(part.column("block"))[words.text_of[at]]
                for block in np.unique(of):
                    found.setdefault(int(block), []).append(hashes[of == block])
        for block in list(found):
            distinct = np.unique(np.concatenate(found.pop(block)))
            cuts = [0, *np.searchsorted(distinct, _bucket_edges(bits)), len(distinct)]
            full = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(full), pa.int32()),
                    pa.array(full, pa.int32()),
                    pa.array([planes(distinct[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                ],
                ["block", "bucket", "hashes"],
            )

    return run


def _held_earlier(table: pa.Table) -> pa.Table:
    """For every block, one bit per hash: does an earlier block hold it?"""
    blocks = np.asarray(table.column("block").combine_chunks())
    lists = table.column("hashes").to_pylist()
    order = np.argsort(blocks, kind="stable")
    runs = [from_planes(lists[i]) for i in order]
    everything = np.concatenate(runs)
    place = np.argsort(everything, kind="stable")  # equal hashes stay in block order
    ordered = everything[place]
    held = np.zeros(len(everything), bool)
    held[place[1:]] = ordered[1:] == ordered[:-1]
    ends = np.cumsum([len(r) for r in runs])
    out = [
        (int(blocks[i]), np.packbits(held[e - len(r) : e]).tobytes())
        for i, r, e in zip(order, runs, ends, strict=True)
        if held[e - len(r) : e].any()
    ]
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "block": pa.array([b for b, _ in out], pa.int32()),
            "bucket": pa.array([bucket] * len(out), pa.int32()),
            "held": pa.array([h for _, h in out], pa.binary()),
        }
    )


def _cut(window: int, bits: int):
    def run(docs: pa.Table, earlier: pa.Table) -> pa.Table:
        docs = docs.select(["doc_id", "text"])
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        docs = docs.combine_chunks()
        words = split_words(docs.column("text"))
        at = window_starts(words, window)
        hashes = rolling(words.hash, window)[at]
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        held = np.zeros(len(distinct), bool)
        cuts = [0, *np.searchsorted(distinct, _bucket_edges(bits)), len(distinct)]
        for bucket, data in zip(earlier.column("bucket").to_pylist(), earlier.column("held").to_pylist(), strict=True):
            a, b = cuts[bucket], cuts[bucket + 1]
            held[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
        repeated = at[held[which] | (first[which] != np.arange(len(at)))]
        return _result(docs.column("doc_id"), words, _covered(words, repeated, window))

    return run


def _covered(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Words that one of the windows covers."""
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:-1] > 0


def _result(ids: pa.ChunkedArray, words: Words, gone: np.ndarray) -> pa.Table:
    spans, kept, removed = [], [], np.zeros(len(words.first) - 1, np.int64)
    raw = words.data.tobytes()
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        mask = gone[a:b]
        removed[i] = np.count_nonzero(mask)
        own = [raw[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
        if removed[i]:
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            own = compress(own, (~mask).tolist())
        else:
            spans.append([])
        kept.append(b" ".join(own).decode())
    return pa.table(
        {
            "doc_id": ids.cast(pa.int64()),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.string()),
        }
    )
