"""Words of whole texts as arrays, for tasks that read Arrow batches.

Works on the bytes of an Arrow string column: no Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

# Bytes of a word from which on it is hashed by itself.
LONG_WORD = 512

# Odd multipliers of the length, word and mixing steps.
LENGTH_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every bit of a 64-bit value."""
    x = x ^ (x >> U64(30))
    x = x * U64(MIX_1)
    x = x ^ (x >> U64(27))
    x = x * U64(MIX_2)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, U64)
        steps[0] = 1
        return np.cumprod(steps)


_words = Powers(WORD_BASE)


@dataclass
class Words:
    """Words of consecutive texts: byte spans, 64-bit hashes, first word of each text."""

    data: np.ndarray  # bytes of all texts, lower-cased if asked for
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1 positions in ``start``

    def of(self, i: int) -> list[bytes]:
        """The words of text ``i``."""
        raw = self.data
        a, b = self.first[i], self.first[i + 1]
        return [raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the len + 1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words between ``space`` bytes and the bytes after them.

    ``offsets`` cut ``raw`` into texts; a word never spans two of them.
    """
    inside = ~space[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    starts[cuts] = inside[cuts]  # a text begins here whatever stands before
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def split_words(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words between ``space`` bytes of every text; a word never spans two texts."""
    raw, offsets = string_bytes(texts)
    if lower:
        raw = LOWER[raw]
    start, end = word_spans(raw, offsets, space)
    return Words(raw, start, end, _hash_spans(raw, start, end), np.searchsorted(start, offsets))


def _hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Eight bytes at a time are mixed in by a bijection, so spans of one length up
    to eight never share a hash, and nothing of it is a polynomial in the bytes.
    Spans of more than LONG_WORD bytes are hashed by BLAKE2.
    """
    lengths = end - start
    out = mix(lengths.astype(U64) * U64(LENGTH_BASE))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # at every byte
    at = np.flatnonzero(lengths <= LONG_WORD)
    done = 0
    while len(at):
        left = np.minimum(lengths[at] - done, 8)
        part = eights[start[at] + done] & (U64(2**64 - 1) >> ((8 - left) * 8).astype(U64))
        out[at] = mix(out[at] ^ part)
        done += 8
        at = at[lengths[at] > done]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive word hashes (across texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    step = 1 << 17  # windows at a time
    for a in range(0, n, step):
        part = hashes[a : min(a + step, n) + size - 1]
        up, down = _words.upto(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up, out=sums[1:])
        m = len(part) - size + 1
        out[a : a + m] = (sums[size:] - sums[:m]) * down[:m]
    return mix(out)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Positions of the first words of all windows that lie inside one text."""
    last = np.repeat(words.first[1:], words.counts) - size
    return np.flatnonzero(np.arange(len(words.hash)) <= last)


def groups_of_rows(batch: pa.RecordBatch, texts: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(texts))
    _, offsets = string_bytes(column)
    a = 0
    while a < batch.num_rows:
        b = max(int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1, a + 1)
        yield batch.slice(a, b - a)
        a = b


def planes(values: np.ndarray, high: int = 8) -> bytes:
    """64-bit values byte plane by byte plane, so that equal bytes compress.

    Only the ``high`` highest bytes are kept.
    """
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[8 - high :]).tobytes()


def from_planes(data: bytes, high: int = 8) -> np.ndarray:
    """The values; bytes that were not kept are 0."""
    rows = np.frombuffer(data, np.uint8).reshape(high, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, 8 - high :] = rows.T
    return out.view("<u8").ravel()
