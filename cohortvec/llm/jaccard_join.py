"""Exact Jaccard join on word shingles with several global token orders.

Sets, not documents, are joined: documents with the same shingles share a
64-bit set number, so copies cost nothing beyond their first.

1. One pass over the texts numbers the sets, counts shingles over all documents
   in a fixed number of counters, and takes a few minima per set.
2. For each of several global orders (rare counters first, then a different
   hash) a set posts its prefix: the tokens of which two similar sets must share
   at least one.
3. Sets that share a minimum are compared with one leader, the one whose posted
   tokens are shared most: a linear number of pairs that joins the larger groups
   of near copies at once.
4. Posted tokens that meet in different groups give pairs, which must also fit
   in size and in how much they can share from that token on, under every order.
5. Pairs left over pass a bitmap bound and are then verified on whole sets.

Tokens posted inside one group only give no pairs, so a group of near copies of
any size costs its postings and one comparison per member.

What two sets can share from a token on: it and what follows it.  Let x be the
set whose prefix ends earlier in the order.  A token of x's prefix that is also
in y lies in y's prefix too, so it is posted twice; tokens that only x has
posted are lost for the pair.  Texts that are variants of one text, each with
changes of its own, are told apart by this before they are paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_groups
from ..session import store
from .sizes import BROADCAST_ROWS, bound_batches, join_counted, store_counted
from .words import U64, Words, from_planes, groups_of_rows, mix, planes, rolling, split_words

SHINGLE = 5
PERCENT = 80
ORDERS = 2
MINIMA = 3
# Counters of shingles, whatever the size of the data: 2 MB of classes.
COUNTER_BITS = 21
PART_BITS = 16
# Bits of a set's bitmap, for sets up to that many tokens.
BITMAPS = {10: 800, 12: 3200, 14: 12_800, 16: math.inf}
# Postings that meet in one task on average, and postings a task holds back.
BUCKET_POSTINGS = 1 << 19
TASK_POSTINGS = 1 << 19
# High bytes of tokens and set numbers that postings carry: what agrees in them
# by chance gives pairs that verification turns down.
POSTED_BYTES = 6
# Bits of the order's last prefix key that are kept with a posting.
LAST_BITS = 16
# A token posted by more sets is paired around its largest group.
WIDE_TOKEN = 64
LOWEST = -(1 << 63)


def _salt(kind: int, number: int) -> np.uint64:
    return mix(np.array([(kind << 32) + number], U64))[0]


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    windows = rolling(words.hash, size)
    short = {n: rolling(words.hash, n) for n in range(1, size)}
    for a, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= size:
            yield np.unique(windows[a : a + n - size + 1])
        elif n:
            yield mix(short[n][a : a + 1] ^ _salt(1, n))
        else:
            yield np.zeros(0, U64)


def _set_number(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum(dtype=U64) + U64(len(tokens))], U64)).view(np.int64)[0])


def _bitmap(tokens: np.ndarray) -> list[int]:
    """A bit for each token; two bitmaps differ in at most as many bits as the sets in tokens."""
    log = next(b for b, limit in BITMAPS.items() if len(tokens) <= limit)
    bits = np.zeros(1 << log, bool)
    bits[(tokens >> U64(64 - log)).astype(np.int64)] = True
    return np.packbits(bits).view("<i8").tolist()


def _each_set(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        for part in groups_of_rows(batch, "text", 1 << 20):
            words = split_words(part.column("text"), lower=True)
            yield from zip(part.column("doc_id").to_pylist(), shingle_sets(words, size), strict=True)


PROFILE = "doc_id bigint, sid bigint, n bigint, minima array<bigint>, bitmap array<bigint>, part int, counts binary"


def _profiles(size: int):
    salts = [_salt(2, k) for k in range(MINIMA)]

    def documents(rows: list[tuple]) -> pa.RecordBatch:
        return _profile_batch([*zip(*rows, strict=True), [None] * len(rows), [None] * len(rows)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting, held = [], [], 0
        counters = np.zeros(1 << COUNTER_BITS, np.int64)

        def count() -> None:
            seen, times = np.unique(np.concatenate(waiting), return_counts=True)
            counters[seen.astype(np.int64)] += times

        for doc_id, tokens in _each_set(batches, size):
            if len(tokens):
                minima = [int(mix(tokens ^ s).min().view(np.int64)) for s in salts]
                rows.append((doc_id, _set_number(tokens), len(tokens), minima, _bitmap(tokens)))
            else:
                rows.append((doc_id, None, 0, None, None))
            waiting.append(tokens >> U64(64 - COUNTER_BITS))
            held += len(tokens)
            if held >= TASK_POSTINGS:
                count()
                waiting, held = [], 0
            if len(rows) >= 5000:
                yield documents(rows)
                rows = []
        if rows:
            yield documents(rows)
        if waiting:
            count()
        if counters.any():
            parts = counters.reshape(-1, 1 << PART_BITS)
            full = [k for k in range(len(parts)) if parts[k].any()]
            empty = [None] * len(full)
            yield _profile_batch([empty] * 5 + [full, [planes(parts[k]) for k in full]])

    return run


def _profile_batch(columns: list) -> pa.RecordBatch:
    names = ["doc_id", "sid", "n", "minima", "bitmap", "part", "counts"]
    numbers = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), numbers, numbers, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _summed_classes(table: pa.Table) -> pa.Table:
    """Counters of one part over all tasks, as the number of bits of each."""
    total = np.zeros(1 << PART_BITS, U64)
    for chunk in table.column("counts").to_pylist():
        total += from_planes(chunk)
    classes = np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
    return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})


def _postings(size: int, classes, buckets_bits: int):
    """Prefix tokens under every order, dealt to buckets of the token's first bits."""
    salts = [_salt(3, k) for k in range(ORDERS)]

    def handed(waiting: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        for order, posted in enumerate(waiting):
            if not posted:
                continue
            tokens = np.concatenate([t for t, _, _ in posted])
            lengths = [len(t) for t, _, _ in posted]
            sids = np.repeat(np.array([s for _, s, _ in posted], np.int64), lengths)
            lasts = np.repeat(np.array([k for _, _, k in posted], np.uint16), lengths)
            places = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            by_token = np.argsort(tokens)
            tokens, sids, places, lasts = tokens[by_token], sids[by_token], places[by_token], lasts[by_token]
            edges = np.arange(1, 1 << buckets_bits, dtype=U64) << U64(64 - buckets_bits)
            cuts = [0, *np.searchsorted(tokens, edges), len(tokens)]
            spans = [(b, cuts[b], cuts[b + 1]) for b in range(1 << buckets_bits) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(order << buckets_bits) + b for b, _, _ in spans], pa.int32()),
                    *(
                        pa.array([planes(v[x:y], POSTED_BYTES) for _, x, y in spans], pa.binary())
                        for v in (tokens, sids.view(U64))
                    ),
                    pa.array([places[x:y].astype("<u4").tobytes() for _, x, y in spans], pa.binary()),
                    pa.array([lasts[x:y].astype("<u2").tobytes() for _, x, y in spans], pa.binary()),
                ],
                ["bucket", "tokens", "sids", "places", "lasts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        waiting, held, seen = [[] for _ in salts], 0, set()
        for _, tokens in _each_set(batches, size):
            n = len(tokens)
            sid = _set_number(tokens) if n else None
            if not n or sid in seen:
                continue  # the same set in this task has posted
            seen.add(sid)
            rare = table[(tokens >> U64(64 - COUNTER_BITS)).astype(np.int64)].astype(U64) << U64(56)
            prefix = n - -(-PERCENT * n // 100) + 1
            for posted, salt in zip(waiting, salts, strict=True):
                keys = rare | (mix(tokens ^ salt) >> U64(8))
                order = np.argsort(keys)[:prefix]
                posted.append((tokens[order], sid, int(keys[order[-1]] >> U64(64 - LAST_BITS))))
                held += prefix
            if held >= TASK_POSTINGS:
                yield from handed(waiting)
                waiting, held, seen = [[] for _ in salts], 0, set()
        yield from handed(waiting)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Postings of tokens that at least two sets have posted."""
    tokens, sids = (
        np.concatenate([from_planes(x, POSTED_BYTES) for x in table.column(c).to_pylist()]) for c in ("tokens", "sids")
    )
    places, lasts = (
        np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        for c, kind in (("places", "<u4"), ("lasts", "<u2"))
    )
    order = np.lexsort((sids, tokens))
    tokens, sids, places, lasts = tokens[order], sids[order], places[order], lasts[order]
    new = np.ones(len(tokens), bool)  # copies in other tasks have posted the same
    new[1:] = (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1])
    tokens, sids, places, lasts = tokens[new], sids[new], places[new], lasts[new]
    twin = tokens[1:] == tokens[:-1]
    live = np.zeros(len(tokens), bool)
    live[1:] |= twin
    live[:-1] |= twin
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "bucket": pa.array(np.full(live.sum(), bucket, np.int32)),
            "token": pa.array(tokens[live].view(np.int64)),
            "posted_sid": pa.array(sids[live].view(np.int64)),
            "place": pa.array(places[live].astype(np.int64)),
            "last": pa.array(lasts[live].astype(np.int32)),
        }
    )


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for _, tokens in _each_set(batches, size):
            if len(tokens):
                rows.append((_set_number(tokens), tokens.view(np.int64)))
                held += len(tokens)
            if held >= 1 << 18:
                yield _set_batch(rows)
                rows, held = [], 0
        yield _set_batch(rows)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([s for s, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["sid", "tokens"])


def _needed(nx: Column, ny: Column) -> Column:
    """Shared tokens that two sets of these sizes need."""
    return F.ceil(PERCENT * (nx + ny) / F.lit(100.0 + PERCENT))


def _fit_in_size(nx: Column, ny: Column) -> Column:
    return 100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)


def _member(met: DataFrame, c: str) -> DataFrame:
    names = {"grp": "g", "sid": "", "n": "n", "place": "p", "ord": "ord", "rest": "rest", "last": "last"}
    return met.select("bucket", "token", *[F.col(k).alias(v + c) for k, v in names.items()])


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are split at ASCII white space, A-Z in lower case.  Two documents link
    when their sets of distinct shingles have a Jaccard similarity of at least
    PERCENT; ``component_id`` is the smallest id that links reach.  A text with
    fewer words than a shingle is one shingle; a null text or one without words
    has none and links with nothing.  Repeated rows and rows that share an id are
    documents of their own; a null id is passed over as smallest unless all are
    null.  Other columns are not looked at.  Runs jobs; intermediate tables are
    written to the shared folder.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = store(rows.mapInArrow(_profiles(shingle), PROFILE), "set-profiles").df
    of_docs = profiles.filter(F.col("part").isNull())
    sets, n_sets = store_counted(
        of_docs.filter(F.col("sid").isNotNull())
        .groupBy("sid", "n", "minima", "bitmap")
        .agg(F.min(F.coalesce("doc_id", F.lit(LOWEST))).alias("key"), F.min("doc_id").alias("first_id")),
        "sets",
    )

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Pairs (x, y) of similar sets, of those that size and bitmap allow."""
        asked, n_asked = store_counted(pairs, f"{label}-asked")
        joined = asked
        for c, limit in (("x", broadcast_rows // 4), ("y", broadcast_rows // 8)):
            side = sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"bits{c}"))
            joined = join_counted(side, joined, n_asked, [c], limit=limit)
        differing = F.aggregate(
            F.zip_with("bitsx", "bitsy", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v
        )
        needed = _needed(F.col("nx"), F.col("ny"))
        close = (F.size("bitsx") != F.size("bitsy")) | (differing <= F.col("nx") + F.col("ny") - 2 * needed)
        possible, n_possible = store_counted(
            joined.filter(_fit_in_size(F.col("nx"), F.col("ny")) & close).select("x", "y", needed.alias("needed")),
            f"{label}-pairs",
        )
        wanted = possible.select(F.explode(F.array("x", "y")).alias("sid")).distinct()
        keys, n_keys = store_counted(
            join_counted(sets.select("sid", "key"), wanted, 2 * n_possible, ["sid"], "left_semi", broadcast_rows)
            .select("key").distinct(),
            f"{label}-keys",
        )
        texts = rows.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
        texts = join_counted(texts, keys, n_keys, ["key"], "left_semi", broadcast_rows)
        whole = store(
            texts.select("doc_id", "text").mapInArrow(_sets(shingle), "sid bigint, tokens array<bigint>"), f"{label}-sets"
        )
        y_side = whole.df.select(F.col("sid").alias("y"), F.col("tokens").alias("ty"))
        x_side = whole.df.select(F.col("sid").alias("x"), F.col("tokens").alias("tx"))
        both = join_counted(y_side, possible, n_possible, ["y"], limit=broadcast_rows).join(x_side, "x")
        shared = F.size(F.array_intersect("tx", "ty"))
        links = store(both.filter(shared >= F.col("needed")).select("x", "y").distinct(), f"{label}-links").df
        whole.discard()
        return links

    # prefixes under every order
    parts = profiles.filter(F.col("part").isNotNull()).select("part", "counts")
    found = parts.groupBy("part").applyInArrow(_summed_classes, "part int, classes binary").collect()
    by_part = {r["part"]: bytes(r["classes"]) for r in found}  # at most 2**COUNTER_BITS bytes
    zero = bytes(1 << PART_BITS)
    classes = b"".join(by_part.get(k, zero) for k in range(1 << (COUNTER_BITS - PART_BITS)))
    total = ORDERS * (sets.agg(F.sum("n")).first()[0] or 0) * (100 - PERCENT) // 100
    bits = min(max(math.ceil(math.log2(max(total / (ORDERS * BUCKET_POSTINGS), 1))), 3), 20)
    posted = rows.mapInArrow(
        _postings(shingle, spark.sparkContext.broadcast(classes), bits),
        "bucket int, tokens binary, sids binary, places binary, lasts binary",
    )
    shared = posted.groupBy("bucket").applyInArrow(
        _shared, "bucket int, token bigint, posted_sid bigint, place bigint, last int"
    )
    cleared = 64 - 8 * POSTED_BYTES
    posters = sets.select("sid", "n", F.shiftleft(F.shiftright("sid", cleared), cleared).alias("posted_sid"))
    posters = join_counted(shared, posters, n_sets, ["posted_sid"], limit=broadcast_rows)
    posters = posters.withColumn("ord", F.shiftright("bucket", bits)).drop("posted_sid")
    # tokens of the set from this one on that others may have: it, those posted
    # twice, and those behind the prefix, of which nothing is known
    later = F.row_number().over(Window.partitionBy("sid", "ord").orderBy(F.col("place").desc()))
    behind = F.ceil(F.col("n") * PERCENT / 100.0) - 1
    live = store(posters.withColumn("rest", behind + later), "postings")
    central = live.df.groupBy("sid").agg(F.count(F.lit(1)).alias("live"))

    # sets that share a minimum, each with the one whose tokens are shared most
    share = F.coalesce(F.col("live") / F.col("n"), F.lit(0.0))
    minima = join_counted(sets.select("sid", "n", "minima"), central, n_sets, ["sid"], "left", broadcast_rows)
    minima = minima.select("sid", share.alias("share"), F.posexplode("minima").alias("k", "minimum"))
    leaders = minima.groupBy("k", "minimum").agg(
        F.max_by("sid", F.struct("share", "sid")).alias("y"), F.count(F.lit(1)).alias("m")
    )
    led = (
        minima.join(leaders.filter(F.col("m") > 1), ["k", "minimum"])
        .filter(F.col("sid") != F.col("y"))
        .select(F.col("sid").alias("x"), "y")
        .distinct()
    )
    first_links = verified(led, "led")
    first_groups, n_groups = store_counted(connected_groups(first_links, "x", "y", "sid", "grp"), "first-groups")

    # posted tokens that meet in different groups
    token = ["bucket", "token"]
    hopeful = live.df.filter(100 * F.col("rest") >= PERCENT * F.col("n"))
    hopeful = join_counted(hopeful, first_groups, n_groups, ["sid"], "left", broadcast_rows)
    hopeful = hopeful.withColumn("grp", F.coalesce("grp", "sid"))
    stats = hopeful.groupBy(*token).agg(
        F.min("grp").alias("a"), F.max("grp").alias("b"), F.count(F.lit(1)).alias("m")
    )
    met = store(hopeful.join(stats.filter("a < b").select(*token, "m"), token), "met")
    live.discard()
    narrow, wide = met.df.filter(F.col("m") <= WIDE_TOKEN), met.df.filter(F.col("m") > WIDE_TOKEN)
    needed = _needed(F.col("nx"), F.col("ny"))
    plain = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= needed
    of_x, of_y = F.col("restx") >= needed, F.col("resty") >= needed
    bound = F.when(F.col("lastx") < F.col("lasty"), of_x).when(F.col("lastx") > F.col("lasty"), of_y).otherwise(of_x | of_y)
    fits = _fit_in_size(F.col("nx"), F.col("ny")) & plain & bound
    directly = _member(narrow, "x").join(_member(narrow, "y"), token).filter((F.col("gx") < F.col("gy")) & fits)
    # of a wide token's largest group no two members are put together
    sizes = wide.groupBy(*token, "grp").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy(*token).agg(F.max_by("grp", F.struct("c", "grp")).alias("largest"))
    others = _member(wide, "x").join(largest, token).filter(F.col("gx") != F.col("largest"))
    once = (F.col("gy") == F.col("largest")) | (F.col("gx") < F.col("gy"))
    around = others.join(_member(wide, "y"), token).filter(once & fits)
    pair = ["x", "y", F.expr("shiftleft(1, ordx)").alias("ord")]
    crossing = (
        directly.select(*pair).unionByName(around.select(*pair))
        .groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .agg(F.bit_or("ord").alias("orders"))
        .filter(F.col("orders") == (1 << ORDERS) - 1)
        .select("x", "y")
    )
    links = first_links.unionByName(verified(crossing, "prefix"))
    met.discard()

    groups, n_groups = store_counted(connected_groups(links, "x", "y", "sid", "grp"), "groups")
    keyed = join_counted(sets.select("sid", "first_id"), groups, n_groups, ["sid"], "left", broadcast_rows)
    keyed = keyed.select("sid", "first_id", F.coalesce("grp", "sid").alias("grp"))
    smallest = keyed.groupBy("grp").agg(F.min("first_id").alias("component_id"))
    named, n_named = store_counted(keyed.join(smallest, "grp").select("sid", "component_id"), "components")
    return join_counted(of_docs.select("doc_id", "sid", "n"), named, n_named, ["sid"], "left", broadcast_rows).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
