"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks: one row per block with the postings of the
items' terms.  Terms have owners, the rarest terms the first one.  A bundle is a
block of documents and a group of items; it carries the sparse sums of their
documents and goes through one stage per owner, where a cogroup meets it with
the owner's postings of the block and adds integer contributions.  After each
stage the items' k-th best sums so far bound the final k-th best from below, and
documents that cannot reach it with all that later owners may add leave the
bundles.  The last stage hands on the best of each block for the selection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stored, store
from .sizes import bound_batches, store_counted
from .words import LOWER, from_planes, groups_of_rows, planes, string_bytes, word_spans

K = 20
OWNERS = 4
# Documents of a block and items of a group: a bundle has at most 2**20 sums.
BLOCK_DOCS = 4096
GROUP_ITEMS = 256
# (item, term) pairs that are searched together and sent to the tasks; more go
# through further waves.
WAVE_PAIRS = 1 << 18

# Fixed values of the terms and of the score: bytes outside of terms, and the
# parts of m and of a term's contribution.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = np.zeros(256, bool)
BREAK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1000
LENGTH_PERCENT = 25
SATURATION = 12

INDEX_SCHEMA = (
    "block bigint, doc_ids array<bigint>, filled bigint, all_terms bigint, "
    "lengths binary, terms binary, places binary, counts binary"
)
POSTINGS_SCHEMA = "block bigint, grp int, terms binary, places binary, impacts binary, n_docs int, doc_ids array<bigint>"
BUNDLE_SCHEMA = "block bigint, grp int, n_docs int, cells binary, sums binary, items array<int>, scores array<bigint>"


def term_weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The integer m of documents with so many terms."""
    share = LENGTH_PERCENT * n_docs
    if len(lengths) and int(lengths.max()) * share >= 1 << 63:
        lengths = lengths.astype(object)
    return (100 - LENGTH_PERCENT + (lengths * share) // all_terms).astype(np.int64)


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term adds to a document for each unit of its weight."""
    return (SCALE**3 * counts) // (SCALE * counts + SATURATION * norms)


@dataclass
class Wave:
    """Items that are searched together, their terms numbered, with weights and owners."""

    items: pa.Array  # ids by number
    words: dict[bytes, int]
    pair_item: np.ndarray
    pair_term: np.ndarray
    pair_count: np.ndarray
    n_docs: int = 0
    all_terms: int = 0
    weight: np.ndarray | None = None  # by term; 0 where it adds nothing
    owner: np.ndarray | None = None  # by term
    reach: np.ndarray | None = None  # item x owner: what later owners may still add

    @property
    def groups(self) -> int:
        return -(-len(self.items) // GROUP_ITEMS)

    def weigh(self, found: pa.Table, owners: int) -> None:
        """Weights, owners and bounds from document counts and highest counts by term."""
        terms = found.column("term").to_numpy()
        df, most = np.zeros((2, len(self.words)), np.int64)
        df[terms], most[terms] = found.column("df").to_numpy(), found.column("most").to_numpy()
        self.weight = np.array([term_weight(self.n_docs, d) if d else 0 for d in df.tolist()], np.int64)
        # rarest first; each owner has about four times the postings of all before
        order = np.argsort(-self.weight, kind="stable")
        mass = np.cumsum(np.where(self.weight > 0, df, 0)[order])
        bounds = [(mass[-1] if len(mass) else 0) / 4.0 ** (owners - 1 - s) for s in range(owners - 1)]
        self.owner = np.empty(len(order), np.int64)
        self.owner[order] = np.searchsorted(bounds, mass, "left")
        highest = impacts(most, np.full(len(most), 100 - LENGTH_PERCENT))
        adds = self.pair_count * (self.weight * highest)[self.pair_term]
        by_owner = np.zeros((len(self.items), owners), np.int64)
        np.add.at(by_owner, (self.pair_item, self.owner[self.pair_term]), adds)
        self.reach = by_owner.sum(axis=1, keepdims=True) - np.cumsum(by_owner, axis=1)

    def of_group(self, group: int, owner: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per term of an owner: items of the group (from 0) and their weights."""
        inside = (self.pair_item // GROUP_ITEMS == group) & (self.owner[self.pair_term] == owner)
        inside &= self.weight[self.pair_term] > 0
        order = np.flatnonzero(inside)[np.argsort(self.pair_term[inside], kind="stable")]
        terms, first = np.unique(self.pair_term[order], return_index=True)
        pairs = np.split(order, first[1:])
        return {
            t: (self.pair_item[p] % GROUP_ITEMS, self.pair_count[p] * self.weight[t])
            for t, p in zip(terms.tolist(), pairs if len(terms) else [], strict=True)
        }


def _wave(pairs: DataFrame) -> Wave:
    """Items and terms of the pairs, numbered; about WAVE_PAIRS rows come to the driver."""
    found = pairs.orderBy("item_id", "term").toArrow()
    ids = found.column("item_id").combine_chunks()
    encoded = ids.dictionary_encode(null_encoding="encode")
    terms = found.column("term").combine_chunks().dictionary_encode()
    words = {word.encode(): i for i, word in enumerate(terms.dictionary.to_pylist())}
    numbers = [pa.chunked_array([e.indices]).to_numpy().astype(np.int64) for e in (encoded, terms)]
    return Wave(encoded.dictionary, words, *numbers, found.column("n").to_numpy())


def index_blocks(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """One row per block of documents: ids, lengths in terms, postings of ``words`` by term.

    ``docs`` has the columns ``doc_id`` and ``text``.  A block lies in one
    partition; its number follows the partition's in the high bits, so the table
    must be written before its numbers are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for part in groups_of_rows(batch, "text"):
                for at in range(0, part.num_rows, BLOCK_DOCS):
                    piece = part.slice(at, BLOCK_DOCS)
                    if held + piece.num_rows > BLOCK_DOCS:
                        yield block(number, parts)
                        parts, held, number = [], 0, number + 1
                    parts.append((piece.column(0), *postings(piece.column(1), held)))
                    held += piece.num_rows
        if held:
            yield block(number, parts)

    def postings(texts: pa.Array, before: int) -> tuple[np.ndarray, ...]:
        raw, offsets = string_bytes(texts)
        raw = LOWER[raw]
        starts, ends = word_spans(raw, offsets, BREAK)
        lengths = np.diff(np.searchsorted(starts, offsets))
        data, get = raw.tobytes(), words.get
        numbers = [get(data[a:b], -1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        numbers = np.array(numbers, np.int64)
        place = np.repeat(np.arange(len(lengths)), lengths) + before
        known = numbers >= 0
        keys, counts = np.unique(numbers[known] * BLOCK_DOCS + place[known], return_counts=True)
        return lengths, keys, counts

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, lengths, keys, counts = zip(*parts, strict=True)
        lengths, keys, counts = map(np.concatenate, (lengths, keys, counts))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        row = {
            "block": number,
            "doc_ids": [i for column in ids for i in column.to_pylist()],
            "filled": int(np.count_nonzero(lengths)),
            "all_terms": int(lengths.sum()),
            "lengths": planes(lengths),
            "terms": planes(keys // BLOCK_DOCS),
            "places": planes(keys % BLOCK_DOCS),
            "counts": planes(counts),
        }
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, INDEX_SCHEMA)


def _integers(data: bytes) -> np.ndarray:
    return from_planes(data).astype(np.int64)


def _term_counts(index: DataFrame) -> DataFrame:
    """``term``, documents that hold it, and its highest count in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros((2, 0), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = _integers(row["terms"]), _integers(row["counts"])
                if len(terms) and int(terms[-1]) >= len(df):
                    wider = max(int(terms[-1]) + 1, 2 * len(df)) - len(df)
                    df, most = np.pad(df, (0, wider)), np.pad(most, (0, wider))
                df[: len(df)] += np.bincount(terms, minlength=len(df))
                np.maximum.at(most, terms, counts)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (terms, df[terms], most[terms])], ["term", "df", "most"])

    counted = index.select("terms", "counts").mapInArrow(run, "term bigint, df bigint, most bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def _postings(index: DataFrame, wave: Wave, owner: int, last: bool) -> DataFrame:
    """Per block and group the postings of an owner's terms, with impacts instead of counts.

    The last owner has a row for every block and group, with the ids of its documents.
    """
    groups, n_docs, all_terms = wave.groups, wave.n_docs, wave.all_terms
    size = len(wave.words)
    mine = ((wave.owner == owner) & (wave.weight > 0))[wave.pair_term]
    group_of, terms_of = wave.pair_item[mine] // GROUP_ITEMS, wave.pair_term[mine]
    wanted = [np.unique(terms_of[group_of == g]) for g in range(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                norms = length_norms(_integers(row["lengths"]), n_docs, all_terms)
                terms, places = _integers(row["terms"]), _integers(row["places"])
                adds = impacts(_integers(row["counts"]), norms[places])
                for group in range(groups):
                    asked = np.zeros(size, bool)
                    asked[wanted[group]] = True
                    own = asked[terms]
                    if last or own.any():
                        yield pa.RecordBatch.from_pylist(
                            [
                                {
                                    "block": row["block"],
                                    "grp": group,
                                    "terms": planes(terms[own]),
                                    "places": planes(places[own]),
                                    "impacts": planes(adds[own]),
                                    "n_docs": len(norms),
                                    "doc_ids": row["doc_ids"] if last else None,
                                }
                            ],
                            pa.schema(
                                [
                                    ("block", pa.int64()),
                                    ("grp", pa.int32()),
                                    ("terms", pa.binary()),
                                    ("places", pa.binary()),
                                    ("impacts", pa.binary()),
                                    ("n_docs", pa.int32()),
                                    ("doc_ids", pa.list_(pa.int64())),
                                ]
                            ),
                        )

    columns = ["block", "lengths", "terms", "places", "counts"]
    read = index.select(*columns, "doc_ids") if last else index.select(*columns)
    return read.mapInArrow(run, POSTINGS_SCHEMA)


def _best(scores: np.ndarray, least: int, k: int, ids: np.ndarray, unnamed: np.ndarray) -> np.ndarray:
    """Places of the k highest scores above 0 and at least ``least``; then smaller ids, null last."""
    found = np.flatnonzero(scores >= max(least, 1))
    if len(found) > k:
        kth = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= kth]
    return found[np.lexsort((ids[found], unnamed[found], -scores[found]))][:k]


def _stage(
    bundles: DataFrame, postings: DataFrame, wave: Wave, owner: int, floor: np.ndarray, k: int, last: bool
) -> DataFrame:
    """Bundles after the contributions of one owner; after the last, the best of each block.

    ``floor``: per item, what the final k-th best score is at least.
    """
    by_group = [wave.of_group(g, owner) for g in range(wave.groups)]
    reach = wave.reach[:, owner]
    n_items = len(wave.items)
    names = ["block", "grp", "n_docs", "cells", "sums", "items", "scores"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        group = key[1].as_py()
        first = group * GROUP_ITEMS
        size = min(n_items - first, GROUP_ITEMS)
        carried, owned = left.to_pylist(), right.to_pylist()
        n_docs = (carried or owned)[0]["n_docs"]
        sums = np.zeros((size, n_docs), np.int64)
        for row in carried:
            if row["cells"] is not None:
                sums.ravel()[np.cumsum(_integers(row["cells"]))] = _integers(row["sums"])
        for row in owned:
            terms, places, adds = (_integers(row[c]) for c in ("terms", "places", "impacts"))
            distinct, at = np.unique(terms, return_index=True)
            for t, a, b in zip(distinct.tolist(), at.tolist(), np.append(at, len(terms))[1:].tolist(), strict=True):
                items, weights = by_group[group][t]
                sums[items[:, None], places[None, a:b]] += weights[:, None] * adds[None, a:b]
        least = floor[first : first + size]
        if last:
            named = pa.array(owned[0]["doc_ids"], pa.int64())
            unnamed = named.is_null().to_numpy(zero_copy_only=False)
            ids = named.fill_null(0).to_numpy()
            tops = [_best(sums[i], int(least[i]), k, ids, unnamed) for i in range(size)]
            counts = [len(top) for top in tops]
            top = np.concatenate(tops)
            item = np.repeat(np.arange(size), counts)
            columns = [
                pa.array(item + first, pa.int32()),
                pa.array(ids[top], pa.int64(), mask=unnamed[top]),
                pa.array(sums[item, top], pa.int64()),
            ]
            return pa.Table.from_arrays(columns, ["item", "doc_id", "score"])
        sums[sums + reach[first : first + size, None] < least[:, None]] = 0
        cells = np.flatnonzero(sums)
        tops = [own if len(own) <= k else np.partition(own, len(own) - k)[-k:] for own in (line[line > 0] for line in sums)]
        row = [
            key[0].as_py(),
            group,
            n_docs,
            planes(np.diff(cells, prepend=0)),
            planes(sums.ravel()[cells]),
            np.repeat(np.arange(size) + first, [len(top) for top in tops]),
            np.concatenate(tops),
        ]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    schema = "item int, doc_id bigint, score bigint" if last else BUNDLE_SCHEMA
    return bundles.groupBy("block", "grp").cogroup(postings.groupBy("block", "grp")).applyInArrow(meet, schema)


def _floors(bundles: DataFrame, n_items: int, k: int) -> np.ndarray:
    """Per item the k-th best sum over all blocks; 0 where there are fewer."""
    pairs = bundles.select(F.explode(F.arrays_zip("items", "scores")).alias("p")).select("p.items", "p.scores")
    place = F.row_number().over(Window.partitionBy("items").orderBy(F.desc("scores")))
    found = pairs.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k).toArrow()
    out = np.zeros(n_items, np.int64)
    out[found.column("items").to_numpy()] = found.column("scores").to_numpy()
    return out


def _search(docs: DataFrame, wave: Wave, k: int, owners: int) -> DataFrame:
    """The k best documents of every item of a wave."""
    spark = docs.sparkSession
    index = store(index_blocks(docs, wave.words), "search-index")
    totals = index.df.agg(F.sum("filled"), F.sum("all_terms")).first()
    wave.n_docs, wave.all_terms = (int(x or 0) for x in totals)
    if not wave.all_terms:
        return spark.createDataFrame([], "item int, doc_id bigint, score bigint")
    wave.weigh(_term_counts(index.df).toArrow(), owners)
    groups = F.explode(F.sequence(F.lit(0), F.lit(wave.groups - 1))).alias("grp")
    nothing = F.lit(None).cast("binary")
    bundles = index.df.select(
        "block", groups, F.size("doc_ids").alias("n_docs"), nothing.alias("cells"), nothing.alias("sums")
    )
    floor, before = np.zeros(len(wave.items), np.int64), None
    for owner in range(owners):
        last = owner == owners - 1
        postings = _postings(index.df, wave, owner, last)
        carried = bundles.select("block", "grp", "n_docs", "cells", "sums")
        after = store(_stage(carried, postings, wave, owner, floor, k, last), f"search-stage-{owner}")
        if before:
            before.discard()
        bundles, before = after.df, after
        if not last:
            floor = np.maximum(floor, _floors(bundles, len(wave.items), k))
    index.discard()
    return bundles


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    owners: int = OWNERS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of every item.

    Terms, weights and scores are those of the module's fixed values; a term
    counts in an item as often as it occurs.  Rows that repeat an item id, null
    included, are one item with all their terms.  Each row of ``docs`` is a
    document of its own.  Only scores above 0 are ranked; equal scores by
    ascending ``doc_id``, null last.  Null texts have no terms; an item without
    terms, or none of whose terms adds anything, has no rows.  Other columns are
    not looked at.

    Blocks of documents meet the owners one by one, so no task holds more than a
    block's sums for a group of items, whatever a term's frequency.  Items go in
    waves of about WAVE_PAIRS distinct (item, term) pairs, each with an index of
    its own; what a wave sends to the tasks is bounded by that number.
    """
    lowered = F.translate(F.col(item_text_col), UPPER_LETTERS, LOWER_LETTERS)
    terms = F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM_PATTERN})")))
    pairs = items.select(F.col(item_col).alias("item_id"), terms.alias("term"))
    pairs, n = store_counted(pairs.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n")), "search-pairs")
    waves = max(-(-n // WAVE_PAIRS), 1)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    results = []
    for number in range(waves):
        mine = F.pmod(F.xxhash64("item_id", F.col("item_id").isNull()), F.lit(waves)) == number
        wave = _wave(pairs.filter(mine))
        if not len(wave.items):
            continue
        best = _search(rows, wave, k, owners)
        order = F.desc("score"), F.col("doc_id").asc_nulls_last()
        place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
        names = pa.table({"item": pa.array(range(len(wave.items)), pa.int32()), "item_id": wave.items})
        named = ranked.join(F.broadcast(spark.createDataFrame(names)), "item")
        results.append(named.select("item_id", "rank", "doc_id", "score"))
    if not results:
        kind = pairs.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, results)
