"""Line deduplication over content-defined chunks of lines, or over all line pairs.

DataFrame functions only.  A rolling hash over the hashes of the last lines
decides where a chunk ends, so the same lines are cut in the same places
wherever they stand in a document.  Chunks of several lines whose hash occurs
more than once are compared by their bytes; all but the first of equal chunks
are removed.

Chunks find a repeated passage only where both copies are cut alike and in
several lines, and most are not.  ``remove_repeated_runs`` takes the lines two by
two at every place instead, so it finds every repeated passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import BROADCAST_ROWS, join_counted, store_counted

# A chunk ends after a line in so many, judged by the last lines.
MEAN_LINES = 4
WINDOW_LINES = 2
# Fixed value: base of the rolling hash; line hashes have 28 bits, so a few
# terms stay far below the largest bigint.
BASE = 31
LOWEST = -(1 << 63)
KEY = ["doc_key", "text_hash"]


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")


def _rolling(hashes: Column, window: int) -> Column:
    """At each line the sum of BASE**k times the hash k lines before."""
    size, total = F.size(hashes), hashes
    for k in range(1, window):
        zeros = F.array_repeat(F.lit(0).cast("bigint"), k)
        before = F.slice(F.concat(zeros, hashes), F.lit(1), size)
        scaled = F.transform(before, lambda h: h * F.lit(BASE**k))  # noqa: B023
        total = F.zip_with(total, scaled, lambda a, b: a + b)
    return total


def line_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean_lines: int = MEAN_LINES,
    window_lines: int = WINDOW_LINES,
) -> DataFrame:
    """Chunks ``doc_key, text_hash, start, end, chunk``: lines from start, end excluded."""
    rows = _keyed(docs, id_col, text_col).filter(F.col("text").isNotNull())
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    hashed = rows.select(*KEY, "lines", F.transform("lines", _line_hash).alias("hashes"))
    rolled = hashed.select(*KEY, "lines", _rolling(F.col("hashes"), window_lines).alias("rolled"))
    # no computed column is named inside a lambda, where it would be computed again per line
    last = F.size("lines")
    marked = F.transform("rolled", lambda r, i: F.when((r % F.lit(mean_lines) == 0) | (i + 1 == last), i + 1))
    ends = F.filter(marked, lambda e: e.isNotNull())
    cut = rolled.select(*KEY, "lines", ends.alias("ends"))
    spans = F.transform(
        "ends", lambda e, k: F.struct(F.coalesce(F.get("ends", k - 1), F.lit(0)).alias("start"), e.alias("end"))
    )
    return cut.select(*KEY, "lines", F.inline(spans)).select(
        *KEY, "start", "end", F.array_join(F.slice("lines", F.col("start") + 1, F.col("end") - F.col("start")), "\n").alias("chunk")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by id and text, so that rows sharing an id stay apart."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("doc_key"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )


def remove_repeated_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean_lines: int = MEAN_LINES,
    window_lines: int = WINDOW_LINES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, removed, kept_text``.

    Lines end at a line feed.  A chunk of at least two lines goes when the same
    bytes are also a chunk earlier: in a document with a smaller id, or before
    in the same document.  Single lines always stay.  ``removed`` lists the
    chunks taken out, as lines, end excluded.  A null text has no line and an
    empty kept text, an empty one has one empty line.  Rows that share an id
    come in the order of a hash of their texts; a null id comes first; rows that
    repeat id and text lose the same chunks.  Other columns are not looked at.
    Runs jobs; intermediate tables are written to the shared folder.
    """
    chunks = line_chunks(docs, id_col, text_col, mean_lines, window_lines).filter(F.col("end") - F.col("start") > 1)
    return _without_repeats(_keyed(docs, id_col, text_col), chunks, broadcast_rows)


def line_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every two adjacent lines, as ``line_chunks`` gives chunks."""
    rows = _keyed(docs, id_col, text_col).filter(F.col("text").isNotNull())
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    n = F.size("lines") - 1
    pairs = F.zip_with(F.slice("lines", F.lit(1), n), F.slice("lines", F.lit(2), n), lambda a, b: F.concat_ws("\n", a, b))
    return rows.select(*KEY, F.posexplode(pairs).alias("start", "chunk")).select(
        *KEY, "start", (F.col("start") + 2).alias("end"), "chunk"
    )


def remove_repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per document, as ``remove_repeated_chunks``; ``removed`` has maximal runs of lines.

    A line goes when two adjacent lines, of which it is one, also stand earlier:
    in a document with a smaller id, or before in the same document.  So every
    repeated passage of two lines or more goes, wherever it begins, and the first
    place of a line always stays.  All pairs are judged on the input; a single
    line that repeats between others stays.  Edge cases as in
    ``remove_repeated_chunks``.
    """
    return _without_repeats(_keyed(docs, id_col, text_col), line_pairs(docs, id_col, text_col), broadcast_rows, overlapping=True)


def _runs(spans: str) -> Column:
    """Spans that may overlap, as maximal runs in order."""
    places = F.array_distinct(F.flatten(F.transform(spans, lambda r: F.sequence(r["start"], r["end"] - 1))))
    after = F.transform(places, lambda p: p + 1)
    starts, ends = F.array_sort(F.array_except(places, after)), F.array_sort(F.array_except(after, places))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def _without_repeats(keyed: DataFrame, chunks: DataFrame, broadcast_rows: int, overlapping: bool = False) -> DataFrame:
    """The rows of ``keyed`` without the chunks that stand earlier too."""
    hashed = chunks.withColumn("chunk_hash", F.xxhash64("chunk"))
    # copies of a chunk are counted map-side, so no chunk is a hot key
    repeated, n_repeated = store_counted(
        hashed.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("chunk_hash"),
        "repeated-chunks",
    )
    suspects = join_counted(hashed, repeated, n_repeated, ["chunk_hash"], "left_semi", broadcast_rows)
    placed, _ = store_counted(
        suspects.select(*KEY, "start", "end", "chunk_hash", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha"), "chunk"),
        "suspects",
    )
    # grouping by the chunk itself is the byte comparison
    first = F.min(F.struct("doc_key", "text_hash", "start"))
    equal, n_equal = store_counted(
        placed.groupBy("chunk_hash", "chunk")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("chunk_hash", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha"), "first"),
        "equal-chunks",
    )
    later = F.struct("doc_key", "text_hash", "start") != F.col("first")
    gone = join_counted(placed.drop("chunk"), equal, n_equal, ["chunk_hash", "chunk_sha"], "inner", broadcast_rows).filter(later)
    spans = gone.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))).alias("removed")
    )
    removed, n_docs = store_counted(spans.withColumn("removed", _runs("removed")) if overlapping else spans, "removed")
    joined = join_counted(keyed, removed, n_docs, KEY, "left", broadcast_rows // 10)
    split = joined.withColumn("lines", F.split("text", "\n", -1))
    # places of the kept lines by a set difference: one step per line
    places = F.sequence(F.lit(0).cast("bigint"), F.size("lines").cast("bigint") - 1)
    gone_places = F.flatten(F.transform("removed", lambda r: F.sequence(r["start"], r["end"] - 1)))
    split = split.withColumn("kept", F.when(F.col("removed").isNotNull(), F.array_except(places, gone_places)))
    kept = F.transform("kept", lambda i: F.get("lines", i.cast("int")))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    return split.select(
        "doc_id",
        F.coalesce(F.array_size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(n_removed, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"),
        F.coalesce(F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")), F.lit("")).alias("kept_text"),
    )
