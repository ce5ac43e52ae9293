"""Token sequences in training order, as shards that are read front to back.

A task tokenises its documents into one stream and cuts it into sequences of a
fixed length, which are written once.  A keyed Feistel network permutes the
numbers of all sequences; numbers outside the range are permuted again until they
fall inside (cycle walking), so every sequence gets a global slot, without gaps.
Slots are dealt by ranges, one task per shard, and each task writes its records
in slot order to one file.  A record has a fixed number of bytes, so slot n
begins at byte (n mod shard size) x stride of shard n div shard size: reading can
start, or go on after a stop, anywhere.

Shards are plain files.  They appear under their name only when complete, and a
write that was stopped goes on with the shards that are missing.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import children, manifest, remove, staged
from .packing import _encoder
from .sizes import bound_batches
from .words import U64, groups_of_rows, mix

LENGTH = 2048
END_ID = 1
ROUNDS = 4
# Sequences of one shard, about 64 MB of tokens.
SHARD_SEQUENCES = 1 << 14
# A record is the number of its tokens, 32 bits, and its ids, 16 bits each.
HEADER_BYTES, ID_BYTES = 4, 2
# Sequences that are packed together while they wait for their slots, and how hard.
BLOCK_SEQUENCES, BLOCK_LEVEL = 128, 6
# Bytes that a task reads at a time.
READ_BYTES = 4 << 20
DRAFT = "_draft-"

@dataclass(frozen=True)
class FeistelPermutation:
    """Keyed bijection of ``range(size)``."""

    size: int
    key: int

    @property
    def _half(self) -> int:
        return max((max(self.size - 1, 1).bit_length() + 1) // 2, 1)

    def _rounds(self) -> np.ndarray:
        return mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(self.key % (1 << 64)))

    def _network(self, value: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half, mask = U64(self._half), U64((1 << self._half) - 1)
        left, right = value >> half, value & mask
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & mask)
        return (left << half) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        keys = self._rounds()
        out = self._network(np.asarray(numbers, U64), keys, back)
        while (outside := out >= U64(self.size)).any():
            out[outside] = self._network(out[outside], keys, back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    """Where the records of an output are."""

    sequences: int
    length: int
    shard_sequences: int
    key: int

    @property
    def stride(self) -> int:
        return HEADER_BYTES + ID_BYTES * self.length

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.shard_sequences)

    def records(self, shard: int) -> int:
        return min(self.sequences - shard * self.shard_sequences, self.shard_sequences)

    def name(self, shard: int) -> str:
        return f"shard-{shard:08d}.tokens"


def _sequences(length: int, end_id: int, tokenizer: str | None):
    """Cuts the documents of a task into sequences, numbered from 0 in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        part, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(BLOCK_LEVEL).compress
        stream: list[int] = []

        def handed(rows: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for at in range(0, len(rows), BLOCK_SEQUENCES):
                some = rows[at : at + BLOCK_SEQUENCES]
                padded = [np.pad(r, (0, length - len(r)), constant_values=end_id) for r in some]
                out.append((part, number, [len(r) for r in some], pack(np.concatenate(padded).tobytes())))
                number += len(some)
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["part", "first", "counts", "block"])

        for batch in batches:
            for some in groups_of_rows(batch, "text"):
                for text in some.column("text").to_pylist():
                    stream += encode(text or "")
                    stream.append(end_id)
                full = len(stream) // length
                if full:
                    ids = np.array(stream[: full * length], "<u2").reshape(full, length)
                    stream = stream[full * length :]
                    yield handed(list(ids))
        if stream:
            yield handed([np.array(stream, "<u2")])

    return run


# Blocks of consecutive sequences: the number of the first, the tokens of each, and all ids, packed.
SEQUENCES = "part int, first bigint, counts array<int>, block binary"


def _slots(order: FeistelPermutation, starts: dict[int, int], length: int):
    """Global slot of each sequence; ``starts``: first number of each task's sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
        size = ID_BYTES * length
        for batch in batches:
            for row in batch.to_pylist():
                n, ids = len(row["counts"]), unpack(row["block"])
                slots = order.slot(starts[row["part"]] + row["first"] + np.arange(n))
                records = [pack(ids[at : at + size]) for at in range(0, n * size, size)]
                columns = [pa.array(slots, pa.int64()), pa.array(row["counts"], pa.int32()), pa.array(records, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "n_tokens", "ids"])

    return run


def _written(folder: str, layout: Layout):
    """Writes a shard's sorted records to its file, unless the file is there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        shard, stream, target, last = None, None, "", -1
        draft = posixpath.join(root, f"{DRAFT}{uuid.uuid4().hex}")
        done, unpack = 0, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column("slot").to_numpy()
            if shard is None:
                shard = int(slots[0]) // layout.shard_sequences
                target = posixpath.join(root, layout.name(shard))
                found = files.get_file_info(target)
                if found.type != fs.FileType.NotFound and found.size == layout.records(shard) * layout.stride:
                    yield _report(shard, layout.records(shard))
                    return
                last = shard * layout.shard_sequences - 1
                stream = files.open_output_stream(draft)
            if not (np.diff(slots, prepend=last) == 1).all():
                raise RuntimeError(f"shard {shard} lacks a record after slot {last}")
            last = int(slots[-1])
            counts = batch.column("n_tokens").to_numpy().astype("<u4")
            for n, ids in zip(counts, batch.column("ids"), strict=True):
                stream.write(n.tobytes() + unpack(ids.as_buffer()))
            done += len(slots)
        if shard is not None:
            stream.close()
            if done != layout.records(shard):
                raise RuntimeError(f"shard {shard} has {done} of {layout.records(shard)} records")
            files.move(draft, target)
            yield _report(shard, done)

    return run


def _report(shard: int, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([records], pa.int64())], ["shard", "records"])


def write_training_order(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    key: int = 42,
    length: int = LENGTH,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    shard_sequences: int = SHARD_SEQUENCES,
) -> Layout:
    """Write all documents as token sequences below ``path``, on storage all tasks share.

    ``shards`` has one file per ``shard_sequences`` slots.  A record is the number
    of tokens (little-endian unsigned 32 bits) and ``length`` ids (16 bits each),
    the last sequence of a task filled up with ``end_id``.  Every document ends
    with ``end_id``; a null or empty text is that id alone; rows that repeat are
    written as often.  Other columns are not looked at.  ``path`` may be any that
    ``pyarrow.fs`` writes to: a local or mounted folder, HDFS, an object store.

    What was written before is an error, unless it was stopped: then the same
    call goes on with the sequences that were cut, if all were, and writes only
    the shards that are missing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if "layout" in children(spark, path):
        raise FileExistsError(f"{path} already exists")
    settings = {"key": key, "length": length, "end_id": end_id, "shard_sequences": shard_sequences}
    cut = f"{path}/sequences"
    if "manifest.json" not in children(spark, cut):
        remove(spark, cut)
        rows = docs.select(F.col(text_col).alias("text"))
        with staged(spark, cut, settings) as parts:
            made = rows.mapInArrow(_sequences(length, end_id, tokenizer), SEQUENCES)
            made.write.option("compression", "none").parquet(parts.path("table"))
    elif manifest(spark, cut)["about"] != settings:
        raise FileExistsError(f"{path} holds sequences of other settings: {manifest(spark, cut)['about']}")
    sequences = spark.read.schema(SEQUENCES).parquet(f"{cut}/table")
    counts = sequences.groupBy("part").agg(F.sum(F.size("counts")).alias("n")).orderBy("part").collect()  # one row a task
    starts = dict(zip((r["part"] for r in counts), accumulate((r["n"] for r in counts), initial=0)))
    layout = Layout(sum(r["n"] for r in counts), length, shard_sequences, key)
    if layout.sequences:
        order = FeistelPermutation(layout.sequences, key)
        placed = sequences.mapInArrow(_slots(order, starts, length), "slot bigint, n_tokens int, ids binary")
        shard = F.floor(F.col("slot") / shard_sequences).cast("int")
        # one task per range of slots
        dealt = placed.repartitionById(layout.shards, shard).sortWithinPartitions("slot")
        _make_folder(spark, f"{path}/shards")
        done = dealt.mapInArrow(_written(f"{path}/shards", layout), "shard int, records bigint").agg(F.sum("records")).first()[0]
        if done != layout.sequences:
            raise RuntimeError(f"{done} of {layout.sequences} sequences were written")
        for name in children(spark, f"{path}/shards"):
            if name.startswith(DRAFT):  # of attempts that failed
                remove(spark, f"{path}/shards/{name}")
    with staged(spark, f"{path}/layout", settings | {"sequences": layout.sequences}):
        pass
    remove(spark, cut)
    return layout


def _make_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(place)


def read_layout(spark: SparkSession, path: str) -> Layout:
    """Layout of a finished output; ``NotCommitted`` for one that was stopped."""
    about = manifest(spark, f"{path}/layout")["about"]
    return Layout(about["sequences"], about["length"], about["shard_sequences"], about["key"])


def read_positions(spark: SparkSession, path: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """Sequences at positions from ``begin``, ``end`` excluded: ``position, shard, n_tokens, ids``.

    Positions are the slots.  One task reads the wanted records of a shard, from
    the byte where they begin; no other shard is opened.
    """
    layout = read_layout(spark, path)
    begin, end = max(begin, 0), layout.sequences if end is None else min(end, layout.sequences)
    schema = "position bigint, shard int, n_tokens int, ids binary"
    if begin >= end:
        return spark.createDataFrame([], schema)
    folder = f"{path}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first = shard * layout.shard_sequences
                at, stop = max(begin - first, 0), min(end - first, layout.records(shard))
                with files.open_input_file(posixpath.join(root, layout.name(shard))) as file:
                    file.seek(at * layout.stride)
                    while at < stop:
                        n = min(stop - at, max(READ_BYTES // layout.stride, 1))
                        yield _records(file.read(n * layout.stride), shard, first + at, n, layout)
                        at += n

    low, high = begin // layout.shard_sequences, (end - 1) // layout.shard_sequences
    return spark.range(low, high + 1, 1, high + 1 - low).mapInArrow(run, schema)


def _records(data: bytes, shard: int, position: int, n: int, layout: Layout) -> pa.RecordBatch:
    raw = np.frombuffer(data, np.uint8).reshape(n, layout.stride)
    counts = np.ascontiguousarray(raw[:, :HEADER_BYTES]).view("<u4").ravel()
    columns = [
        pa.array(np.arange(position, position + n), pa.int64()),
        pa.array(np.full(n, shard), pa.int32()),
        pa.array(counts.astype(np.int32)),
        pa.array([row.tobytes() for row in raw[:, HEADER_BYTES:]], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["position", "shard", "n_tokens", "ids"])
