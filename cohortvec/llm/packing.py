"""Packing of documents into windows of a fixed number of tokens.

A task tokenises its documents whole.  Full windows are cut off a document at
once; what remains of each is balanced over the windows of its group by
multiway differencing (Karmarkar and Karp): the two partial partitions with the
largest spread are merged, the fullest part of one with the emptiest of the
other, until one partition is left.  While its fullest window exceeds the
capacity, the window count rises; once that would pad more than allowed, the
excess is cut off and moved to windows with room.

Groups are packed where they are tokenised, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .sizes import bound_batches
from .words import groups_of_rows

CAPACITY = 2048
END_ID = 1
# Windows that are balanced together, and the share of padding that raising
# their number may cost.
GROUP_WINDOWS = 256
MAX_PADDING = 0.01
# Sequence numbers of a task follow its partition number in the high bits.
SEQUENCE_BITS = 40

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)


@functools.cache
def _encoder(path: str):
    """Text to ids of the tokenizer file at ``path``, no special tokens added.

    The file's own byte-level vocabulary drives tiktoken, which is several times
    faster with the same ids.  Texts that hold one of the file's added tokens,
    which are ids of their own, and texts with endless white space, which the
    pattern can't match, go to the slower library.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = {token["content"] for token in content["added_tokens"]}
    # fixed rule of byte-level vocabularies: printable bytes stand for
    # themselves, the others for characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    words = {word: i for word, i in content["model"]["vocab"].items() if word not in added and all(c in byte_of for c in word)}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in words.items()}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    unusual = re.compile("|".join([r"\s{5000}", *map(re.escape, sorted(added))]))
    slow = functools.cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        if unusual.search(text):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Items of each window; window sums are near-equal (Karmarkar-Karp).

    A partition is ``windows`` pairs (sum, tree of items) in descending order of
    sums, the smallest taken off all.  Trees are numbered: below ``len(sizes)``
    an item, above a join of two trees, -1 nothing.
    """
    n = len(sizes)
    if windows == 1 or n <= 1:
        return [list(range(n))] + [[] for _ in range(windows - 1)]
    parts = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, trees = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], trees[0] = size, i
        parts[i] = sums, trees
        heap.append((-size, i))
    heapq.heapify(heap)
    lefts, rights, nodes, made = [], [], n, n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sums_a, trees_a), (sums_b, trees_b) = parts.pop(a), parts.pop(b)
        sums_b, trees_b = sums_b[::-1], trees_b[::-1]
        sums = sums_a + sums_b
        both = (trees_a >= 0) & (trees_b >= 0)
        trees = np.maximum(trees_a, trees_b)
        count = int(np.count_nonzero(both))
        if count:
            lefts.append(trees_a[both])
            rights.append(trees_b[both])
            trees[both] = np.arange(nodes, nodes + count)
            nodes += count
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        sums -= sums[-1]
        parts[made] = sums, trees
        heapq.heappush(heap, (-int(sums[0]), made))
        made += 1
    left = np.concatenate(lefts).tolist() if lefts else []
    right = np.concatenate(rights).tolist() if rights else []
    out = []
    for tree in parts[heap[0][1]][1].tolist():
        items, open_trees = [], [tree] if tree >= 0 else []
        while open_trees:
            t = open_trees.pop()
            if t < n:
                items.append(t)
            else:
                open_trees += [right[t - n], left[t - n]]
        out.append(items)
    return out


def fill_windows(sizes: np.ndarray, capacity: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """Pieces ``(item, start, length)`` of each window; no window above ``capacity``."""
    total = int(sizes.sum())
    windows = max(-(-total // capacity), 1)
    while True:
        found = differencing(sizes, windows)
        if max(int(sizes[w].sum()) for w in found) <= capacity:
            break
        if (windows + 1) * capacity - total > max_padding * total:
            break
        windows += 1
    pieces, excess = [], []
    for items in found:
        room, own = capacity, []
        for i in items:
            take = min(int(sizes[i]), room)
            if take:
                own.append((i, 0, take))
            if take < sizes[i]:
                excess.append((i, take, int(sizes[i]) - take))
            room -= take
        pieces.append((own, room))
    out = []
    for own, room in pieces:
        while room and excess:
            i, start, length = excess.pop()
            take = min(length, room)
            own.append((i, start, take))
            room -= take
            if take < length:
                excess.append((i, start + take, length - take))
        if own:
            out.append(own)
    return out


class _Sequences:
    """Gathers the pieces of one task and numbers its sequences."""

    def __init__(self, capacity: int, group: int, max_padding: float) -> None:
        self.capacity, self.group, self.max_padding = capacity, group, max_padding
        self.next = TaskContext.get().partitionId() << SEQUENCE_BITS
        self.waiting: list[tuple[int | None, int, int, np.ndarray]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._put(doc_id, start, len(ids), ids[start : start + self.capacity], 0)
            self.next += 1
        if whole < len(ids):
            self.waiting.append((doc_id, whole, len(ids), ids[whole:]))
            self.tokens += len(ids) - whole
        if self.tokens >= (self.group - 1) * self.capacity:
            self.pack()

    def _put(self, doc_id: int | None, start: int, total: int, ids: np.ndarray, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids), total, self.next, offset, ids.tobytes()))

    def pack(self) -> None:
        if not self.waiting:
            return
        sizes = np.array([len(w[3]) for w in self.waiting], np.int64)
        for pieces in fill_windows(sizes, self.capacity, self.max_padding):
            offset = 0
            for i, start, length in pieces:
                doc_id, before, total, ids = self.waiting[i]
                self._put(doc_id, before + start, total, ids[start : start + length], offset)
                offset += length
            self.next += 1
        self.waiting, self.tokens = [], 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 7
        self.rows = []
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "ids"])


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    group_windows: int = GROUP_WINDOWS,
    max_padding: float = MAX_PADDING,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    ``start`` and ``length`` count the document's ids, ``ids`` holds them as
    little-endian unsigned 32-bit numbers, ``offset`` is the place in sequence
    ``sequence_id``, without gaps from 0.  Every document ends with ``end_id``;
    null or empty text is that id alone.  Repeated rows are packed as often as
    they come; a null id stays null.  Other columns are not looked at.  A task
    leaves at most one group that is not full.  ``tokenizer`` is a path on the
    executors; without it they look up the public one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        sequences = _Sequences(capacity, group_windows, max_padding)
        for batch in batches:
            for part in groups_of_rows(batch, "text"):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "")
                    ids.append(end_id)
                    sequences.add(doc_id, np.array(ids, "<u4"))
                yield sequences.taken()
        sequences.pack()
        yield sequences.taken()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
