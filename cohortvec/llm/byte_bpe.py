"""Byte-level byte pair encoding in padded matrices, and decoding.

A task cuts its texts into pieces by the tokenizer's pattern, on arrays of
character classes.  The distinct pieces of a slice are bucketed by length, one
matrix of ids per bucket and one row per piece.  In every round each row merges
its leftmost pair of least rank; the pairs' ranks come from a hash table, and
both matrices are compacted by the column that each row lost and by the rows
that have nothing left to merge.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizes import bound_batches
from .words import groups_of_rows, string_bytes

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
# Cells of a matrix at most, and the longest piece that gets a row.  Longer
# pieces would need a round per byte over a row as long.
CELLS = 1 << 19
LONGEST_ROW = 1024
# Fixed value: odd multiplier of the pair hash.
PAIR_BASE = np.uint64(0x9E3779B97F4A7C15)

OTHER, LETTER, NUMBER, WHITE = range(4)


class PairTable:
    """Ranks of pairs of ids in an open-addressed hash table of arrays."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(int(4 * len(rank) + 1).bit_length(), 4)
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.EMPTY)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys, rank = self._key(left, right), np.asarray(rank, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == self.EMPTY
            _, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], rank[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + np.uint64(1)) & self.last

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * PAIR_BASE) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no pair."""
        keys = self._key(left, right).ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.last
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.ranks[slot[open_[same]]]
            open_ = open_[~same & (held != self.EMPTY)]
        return out.reshape(left.shape)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + count - 1`` of all spans, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class Vocabulary:
    """Words with their ranks, which are their ids, and all ways to make one of two."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        get = ranks.get
        pairs = [
            (a, b, rank)
            for word, rank in ranks.items()
            for i in range(1, len(word))
            if (a := get(word[:i])) is not None and (b := get(word[i:])) is not None
        ]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        lengths = np.array([len(w or b"") for w in self.words], np.int64)
        self.known = np.array([w is not None for w in self.words])
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.blob = np.frombuffer(b"".join(w or b"" for w in self.words), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and their number for each piece."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(np.array(whole, np.int64) >= 0)
        done.append((single, np.ones(len(single), np.int64), np.array(whole, np.int64)[single].astype(np.int32)))
        buckets: dict[int, list[int]] = {}
        for i, (piece, rank) in enumerate(zip(pieces, whole, strict=True)):
            if rank < 0:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            if 1 << bits > LONGEST_ROW:
                for i in rows:
                    ids = self.merge_long(pieces[i])
                    done.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))
                continue
            step = max(CELLS >> bits, 1)
            for at in range(0, len(rows), step):
                self._merge_rows(rows[at : at + step], pieces, 1 << bits, done)
        counts = np.zeros(len(pieces), np.int64)
        for rows, n, _ in done:
            counts[rows] = n
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for rows, n, ids in done:
            flat[spans(starts[rows], n)] = ids
        return flat, counts

    def _merge_rows(self, numbers: list[int], pieces: list[bytes], width: int, done: list) -> None:
        """Merge pieces of at most ``width`` bytes, a matrix row each."""
        rows = np.array(numbers)
        data = [pieces[i] for i in numbers]
        lengths = np.array([len(p) for p in data])
        ids = np.full((len(rows), width), NONE, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            ready = best == NONE
            if ready.any():
                inside = ids[ready] != NONE
                done.append((rows[ready], inside.sum(axis=1), ids[ready][inside]))
                left = ~ready
                rows, ids, ranks, at, best = rows[left], ids[left], ranks[left], at[left], best[left]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            ids[line, at] = best
            stays = np.ones(ids.shape, bool)
            stays[line, at + 1] = False
            shape = len(rows), ids.shape[1] - 1
            ids, ranks = ids[stays].reshape(shape), ranks[stays].reshape(shape)
            after, before = np.minimum(at + 1, shape[1] - 1), np.maximum(at - 1, 0)
            ranks[line, at] = np.where(at + 1 < shape[1], self.pairs.find(best, ids[line, after]), NONE)
            ranks[line, before] = np.where(at > 0, self.pairs.find(ids[line, before], best), ranks[line, before])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges in the same order for one long piece, from a heap of pairs."""
        n = len(piece)
        first = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = [*self.pairs.find(first[:-1], first[1:]).tolist(), int(NONE)]
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, rank in enumerate(ranks) if rank != NONE]
        heapq.heapify(heap)

        def pair(i: int, j: int) -> None:
            ranks[i] = self.ranks.get(self.words[ids[i]] + self.words[ids[j]], int(NONE)) if j < n else int(NONE)
            if ranks[i] != NONE:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue  # the pair has changed meanwhile
            j = after[i]
            ids[i], ids[j], ranks[j] = rank, -1, int(NONE)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            pair(i, after[i])
            if before[i] >= 0:
                pair(before[i], i)
        return [i for i in ids if i >= 0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the places where each row's bytes begin and end."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return self.blob[spans(self.starts[ids], lengths)], ends[offsets]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file: a word in base 64 and its rank per line."""
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)})


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own patterns see it."""
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], "<u4")
    text = points.tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    return table


def split_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes where pieces begin, and the first piece of each text (one more at the end).

    Pieces are the matches of the public tokenizers' pattern: runs of letters,
    of numbers and of other characters, each with one blank before it; white
    space; and seven endings after an apostrophe.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = character_classes()[points]
    n = len(points)
    bounds = np.searchsorted(place, offsets)  # code points where texts begin
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    fresh[n] = True
    begins = fresh[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    # white space before a character of the same text: its last one stands alone,
    # and a blank goes with what follows
    white = (kind[runs] == WHITE) & ~fresh[ends]
    begins[ends[white] - 1] = True
    joined = ends[white][points[ends[white] - 1] == ord(" ")]
    begins[joined] = False
    # an apostrophe that begins a piece, before one of the endings
    marks = np.flatnonzero((points == ord("'")) & begins)
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = padded[marks + 1], padded[marks + 2]
    next_in, after_in = ~fresh[np.minimum(marks + 1, n)], ~fresh[np.minimum(marks + 2, n)]
    short = next_in & np.isin(one, [ord(c) for c in "stmd"])
    long_ = np.zeros(len(marks), bool)
    for a, b in ("re", "ve", "ll"):
        long_ |= next_in & after_in & (one == ord(a)) & (two == ord(b))
    for at, size in ((marks[short], 2), (marks[long_], 3)):
        begins[at + 1] = False
        stop = at + size
        begins[stop[stop < n]] = True
    starts = np.flatnonzero(begins)
    return place[starts], np.searchsorted(starts, bounds)


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column over ready buffers (32-bit offsets)."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) per row.

    Every match of the pattern is encoded by itself: a word of the vocabulary is
    its id, any other piece is merged from bytes.  There are no special tokens.
    Null or empty text has no ids; a null id stays null, repeated rows are
    encoded as often as they come, other columns are not looked at.  ``ranks`` is
    a path on the executors; without it they look up the public file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks or public_tokenizers.path(RANKS))
        for batch in batches:
            for part in groups_of_rows(batch, "text"):
                raw, offsets = string_bytes(part.column(1))
                starts, first = split_pieces(raw, offsets)
                data, numbers = raw.tobytes(), {}
                ends = [*starts[1:].tolist(), len(data)]
                which = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends)]
                flat, counts = words.encode_pieces(list(numbers))
                which = np.array(which, np.int64)
                own = counts[which]
                ids = flat[spans((np.cumsum(counts) - counts)[which], own)].astype("<u4")
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])[first]
                columns = [part.column(0), pa.array(np.diff(bounds), pa.int64()), _binary(bounds * 4, ids)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode_ids(
    rows: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", ranks: str | None = None
) -> DataFrame:
    """``rows`` with the bytes that ``ids_col`` stands for in a new column ``decoded_col``.

    Null ids count as none.  An id outside the vocabulary is an error, as is a
    column of that name that is already there.
    """
    if decoded_col in rows.columns:
        raise ValueError(f"there is a column {decoded_col!r} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks or public_tokenizers.path(RANKS))
        for batch in batches:
            lists = batch.column(ids_col).to_pylist()
            at = 0
            while at < len(lists):
                end, size = at, 0
                while end < len(lists) and (end == at or size < 1 << 20):
                    size += len(lists[end] or b"")
                    end += 1
                sizes = np.array([len(x or b"") // 4 for x in lists[at:end]], np.int64)
                ids = np.frombuffer(b"".join(x or b"" for x in lists[at:end]), "<u4")
                data, bounds = words.decode(ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))
                yield batch.slice(at, end - at).append_column(decoded_col, _binary(bounds, data))
                at = end

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(decoded_col, T.BinaryType())]))
