"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only.  The corpus is counted for the benchmark's words;
postings (word, document, position) are stored for the rarest words of each
benchmark window.  A posting minus the word's place in the item is the place
where the item would begin in the document, so the offset-adjusted lists of a
window's rarest words meet in equal numbers; what meets is compared word by word
on the documents themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .sizes import BROADCAST_ROWS, join_counted, store_counted

WINDOW = 13
# Rarest words of a window whose posting lists are intersected.
RAREST = 2
# A document is contaminated from one hit word in so many.
HIT_SHARE = 20
LOWEST = -(1 << 63)
# Places of a document whose candidates share one splitting of its text.
STRETCH = 4096

# What separates words, and the letters put in lower case.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

KEY = ["doc_key", "text_hash"]


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case; other letters stay (``lower`` is faster, but right for ASCII only)."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _pieces(text: str) -> Column:
    """Words as written; the first and the last may be empty."""
    return F.split(F.coalesce(F.col(text), F.lit("")), BREAKS)


def _words(text: str) -> Column:
    return F.filter(F.transform(_pieces(text), ascii_lower), lambda w: w != "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by id and text, so that rows sharing an id stay apart."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("doc_key"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )


def _benchmark(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items with words: ``item_no, item_id, item_words``; rows with words are counted."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), F.col(text_col).alias("text"))
    rows = rows.select("item_id", _words("text").alias("item_words")).filter(F.size("item_words") > 0)
    return store_counted(rows.distinct().withColumn("item_no", F.xxhash64("item_id", "item_words")), "items")


def term_postings(docs: DataFrame, terms: DataFrame, n_terms: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Positional postings ``term, doc_key, text_hash, place`` of the given terms.

    ``place`` counts from 0; a text that begins with a separator counts from 1.
    """
    tokens = docs.select(*KEY, F.posexplode(_pieces("text")).alias("place", "word"))
    tokens = tokens.select(*KEY, "place", ascii_lower(F.col("word")).alias("term"))
    return join_counted(tokens, terms.select("term"), n_terms, ["term"], "inner", broadcast_rows)


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``term, n``: occurrences in the corpus, 0 included."""
    tokens = docs.select(F.explode(_pieces("text")).alias("word")).select(ascii_lower(F.col("word")).alias("term"))
    found = (
        join_counted(tokens, terms.select("term"), n_terms, ["term"], "inner", broadcast_rows)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return terms.select("term").join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def phrase_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    rarest: int = RAREST,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every exact occurrence of an item window: ``doc_key, text_hash, item_id, start, length``.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window.  ``start`` is a place as in ``term_postings``.  Items without
    words have no window, null texts no words; a null item id reads "null".
    Repeated rows match once.  Runs jobs: items, counts, postings and
    candidates are written to the shared folder.
    """
    keyed = _keyed(docs, id_col, text_col)
    bench, n_items = _benchmark(items, item_col, item_text_col)
    places = bench.select("item_no", F.size("item_words").alias("size"), F.posexplode("item_words").alias("at", "term"))
    terms, n_terms = store_counted(places.select("term").distinct(), "terms")
    counts = store(term_counts(keyed, terms, n_terms, broadcast_rows), "term-counts").df

    # windows with the places of their rarest words
    begins = bench.select(
        "item_no",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("item_words") - window, F.lit(0)))).alias("begin"),
        F.least(F.size("item_words"), F.lit(window)).alias("length"),
    )
    in_window = begins.join(places.join(counts, "term"), "item_no").filter(
        (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("begin") + F.col("length"))
    )
    by_rarity = F.array_sort(F.collect_list(F.struct("n", "at")))
    windows, n_windows = store_counted(
        in_window.groupBy("item_no", "begin", "length").agg(F.slice(by_rarity, 1, rarest)["at"].alias("anchors")), "windows"
    )
    anchors, n_anchors = store_counted(
        windows.select("item_no", F.explode("anchors").alias("at")).distinct().join(places, ["item_no", "at"]).select("item_no", "at", "term"),
        "anchors",
    )

    # the index: posting lists of the rarest words
    listed, n_listed = store_counted(anchors.select("term").distinct(), "listed-terms")
    postings = store(term_postings(keyed, listed, n_listed, broadcast_rows), "postings").df
    met = (
        join_counted(postings, anchors, n_anchors, ["term"], "inner", broadcast_rows)
        .groupBy(*KEY, "item_no", (F.col("place") - F.col("at")).alias("origin"))
        .agg(F.collect_set("at").alias("met"))
    )
    enough = join_counted(met, windows, n_windows, ["item_no"], "inner", broadcast_rows).filter(
        F.size(F.array_except("anchors", "met")) == 0
    )
    sizes = bench.select("item_no", F.size("item_words").alias("size"))
    wanted = join_counted(enough.select(*KEY, "item_no", "origin").distinct(), sizes, n_items, ["item_no"], "inner", broadcast_rows)
    candidates, n_candidates = store_counted(wanted, "candidates")

    # word by word on the documents that have candidates: a document's words are
    # made once for the candidates of a stretch, and each takes its own few
    stretch = F.floor(F.col("origin") / STRETCH).alias("stretch")
    by_doc = candidates.groupBy(*KEY, stretch).agg(F.collect_list(F.struct("item_no", "origin", "size")).alias("asked"))
    texts = join_counted(keyed, by_doc, n_candidates, KEY, "inner", broadcast_rows)
    # a generator's column is not computed again per element of a lambda
    split = texts.select(*KEY, "asked", F.explode(F.array(F.transform(_pieces("text"), ascii_lower))).alias("words"))
    aligned = split.select(
        *KEY,
        F.inline(
            F.transform(
                "asked",
                lambda c: F.struct(
                    c["item_no"].alias("item_no"),
                    c["origin"].alias("origin"),
                    F.slice(
                        F.col("words"), F.greatest(c["origin"], F.lit(0)) + 1, F.greatest(c["size"] + F.least(c["origin"], F.lit(0)), F.lit(0))
                    ).alias("words"),
                ),
            )
        ),
    )
    both = join_counted(aligned, bench, n_items, ["item_no"], "inner", broadcast_rows // 10)
    length = F.least(F.size("item_words"), F.lit(window))
    missing = F.greatest(-F.col("origin"), F.lit(0))  # words of the item before the document's first
    begins = F.filter(
        F.sequence(F.lit(0), F.size("item_words") - length),
        lambda b: (b >= missing) & (F.slice("words", F.greatest(b - missing, F.lit(0)) + 1, length) == F.slice("item_words", b + 1, length)),
    )
    found = both.select(*KEY, "item_id", "origin", length.alias("length"), F.explode(begins).alias("begin"))
    return found.select(*KEY, "item_id", (F.col("origin") + F.col("begin")).alias("start"), "length").distinct()


def proximity_matches(
    docs: DataFrame,
    items: DataFrame,
    span: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Places from which ``span`` words hold every word of an item: ``doc_key, text_hash, item_id, start``.

    Order and number of the item's words do not matter; ``start`` is the place
    of one of them.  Only documents that hold the item's rarest word are looked
    at.  Edge cases as in ``phrase_matches``.
    """
    keyed = _keyed(docs, id_col, text_col)
    bench, _ = _benchmark(items, item_col, item_text_col)
    wanted = bench.select("item_no", "item_id", F.explode(F.array_distinct("item_words")).alias("term"))
    terms, n_terms = store_counted(wanted.select("term").distinct(), "terms")
    postings = store(term_postings(keyed, terms, n_terms, broadcast_rows), "postings").df.distinct()
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    listed, n_wanted = store_counted(wanted.join(counts, "term", "left").fillna(0, ["n"]), "wanted")
    rarest = listed.groupBy("item_no").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count(F.lit(1)).alias("words"))
    holders = postings.join(rarest, "term").select(*KEY, "item_no", "words").distinct()
    near = join_counted(postings, listed, n_wanted, ["term"], "inner", broadcast_rows).join(holders, [*KEY, "item_no"])
    ahead = Window.partitionBy(*KEY, "item_no").orderBy("place").rangeBetween(0, span - 1)
    return (
        near.withColumn("held", F.size(F.collect_set("term").over(ahead)))
        .filter(F.col("held") == F.col("words"))
        .select(*KEY, "item_id", F.col("place").alias("start"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, item_ids, contaminated``.

    ``n_hit`` counts the words inside any occurrence of an item window,
    ``item_ids`` lists the items that occur, sorted as strings; contaminated
    from one hit word in HIT_SHARE.  Edge cases as in ``phrase_matches``; rows
    that repeat a document get the same result.
    """
    matches = phrase_matches(docs, items, id_col, text_col, item_col, item_text_col, window, broadcast_rows=broadcast_rows)
    found = store(matches, "matches").df
    # words not covered by an earlier match of the document
    before = Window.partitionBy(*KEY).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = found.select(*KEY, "start", "length").distinct().withColumn("reached", F.max(end).over(before))
    new = F.greatest(end - F.greatest("start", F.coalesce("reached", "start")), F.lit(0))
    hits = spans.groupBy(*KEY).agg(F.sum(new).cast("bigint").alias("n_hit"))
    named = found.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per_doc, n_docs = store_counted(hits.join(named, KEY), "hit-documents")

    pieces = _pieces("text")
    last = F.element_at("pieces", -1) == ""
    counted = _keyed(docs, id_col, text_col).select("doc_id", *KEY, pieces.alias("pieces"))
    # a text of separators alone is two empty pieces, an empty text is one
    n_words = F.size("pieces") - (F.col("pieces")[0] == "").cast("int") - ((F.size("pieces") > 1) & last).cast("int")
    sized = counted.select("doc_id", *KEY, n_words.cast("bigint").alias("n_words"))
    joined = join_counted(sized, per_doc, n_docs, KEY, "left", broadcast_rows)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.array_size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
