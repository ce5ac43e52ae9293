import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortvec.llm import lexical_search as s

ITEMS = "item_id bigint, text string, rank int, score string, item int, term string"


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranks(docs, items, k=20):
    held = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, query in queries.items():
        scored = []
        for doc_id, counts in held:
            m = 75 + (25 * sum(counts.values()) * n_docs) // total
            score = 0
            for t, times in query.items():
                if t in counts:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def found(docs, items, **options):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in s.rank_documents(docs, items, **options).collect())


def random_tables(seed, n_docs, n_items):
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)] + ["Été", "x9", "the", "a"]
    weights = [1 / (i + 1) for i in range(304)]
    text = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    docs = [(i, text(draw.randint(1, 60))) for i in range(n_docs)]
    items = [(i, text(draw.randint(1, 25))) for i in range(n_items)]
    return docs, items


@pytest.mark.parametrize(("k", "owners"), [(20, 4), (3, 4), (5, 1), (2, 7)])
def test_against_all_scores(spark, documents, k, owners):
    docs, items = random_tables(k, 700, 30)
    got = found(documents(docs).repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), k=k, owners=owners)
    assert got == plain_ranks(docs, items, k)


def test_small_blocks_groups_and_waves(spark, documents, monkeypatch):
    """Many bundles, several waves: the same ranks."""
    docs, items = random_tables(11, 300, 25)
    monkeypatch.setattr(s, "BLOCK_DOCS", 16)
    monkeypatch.setattr(s, "GROUP_ITEMS", 4)
    monkeypatch.setattr(s, "WAVE_PAIRS", 60)
    got = found(documents(docs).repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), k=4)
    assert got == plain_ranks(docs, items, 4)


def test_special_rows(spark, documents, long_text):
    docs = [(1, None), (2, ""), (3, "Alpha beta"), (4, "alpha BETA"), (4, "alpha BETA"), (None, "alpha beta"), (6, "... !!"), (7, long_text), (8, "é É alpha")]
    items = [(10, "ALPHA alpha beta"), (11, None), (11, "beta"), (None, "é w7919"), (12, ""), (13, "unknown term"), (14, None)]
    rows = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in items], ITEMS)
    assert found(documents(docs), rows) == plain_ranks(docs, items)


def test_ties_beyond_k(spark, documents):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(100 + i, f"other{i} text") for i in range(100)]
    items = [(1, "words"), (2, "text"), (3, "nothing")]
    got = s.rank_documents(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert [r.doc_id for r in got.filter("item_id = 1").orderBy("rank").collect()] == list(range(1, 21))
    assert found(documents(docs), spark.createDataFrame(items, "item_id bigint, text string")) == plain_ranks(docs, items)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert found(documents([]), items) == found(documents([(1, "word")]), none) == found(documents([(1, None)]), items) == []
    # a term that every document holds has no weight
    assert found(documents([(i, "word") for i in range(2000)]), items) == []


def test_bounds_leave_documents_out(spark, documents, monkeypatch):
    """Sums that cannot reach the k-th best do not travel on."""
    docs, items = random_tables(5, 2000, 10)
    sizes = {}
    plain = s.store

    def watched(df, label, *args):
        stored = plain(df, label, *args)
        if label.startswith("search-stage") and "sums" in stored.df.columns:
            rows = stored.df.select("sums").collect()
            sizes[label] = sum(len(r.sums) // 8 for r in rows)
        return stored

    monkeypatch.setattr(s, "store", watched)
    got = found(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"), k=3)
    assert got == plain_ranks(docs, items, 3)
    pairs = sum(1 for _, q in items for _, t in docs if set(terms_of(q)) & set(terms_of(t)))
    assert 0 < sizes["search-stage-2"] < pairs / 3


def test_long_norms_do_not_overflow():
    lengths = np.array([1, 10**9])
    want = [75 + (25 * n * 10**11) // 10**13 for n in lengths.tolist()]
    assert s.length_norms(lengths, 10**11, 10**13).tolist() == want
