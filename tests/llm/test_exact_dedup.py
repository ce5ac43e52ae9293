import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cohortvec.llm import exact_dedup as e
from cohortvec.llm.exact_dedup import CountingQuotientFilter, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(long_text):
    return [
        (1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, long_text), (7, long_text), (8, long_text + "."),
        (None, "a"), (None, "n"), (9, "twin"), (9, "twin"), (10, "A"), *((100 + i, "hot") for i in range(300)),
    ]


def test_edge_cases(documents, rows):
    assert rows_of(exact_duplicates(documents(rows))) == brute(rows)


def test_colliding_fingerprints_are_told_apart(documents, rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(e.F, "xxhash64", lambda *c: F.length(F.col(c[0])).cast("bigint"))
    assert rows_of(exact_duplicates(documents(rows))) == brute(rows)


def test_joins_by_shuffle_give_the_same(documents, rows, monkeypatch):
    join = e.join_counted
    monkeypatch.setattr(e, "join_counted", lambda a, b, n, on, how="inner", limit=0: join(a, b, n, on, how, -1))
    assert rows_of(exact_duplicates(documents(rows))) == brute(rows)


def test_empty_table(documents):
    assert exact_duplicates(documents([])).collect() == []


def test_filters_merge_without_loss():
    rng = np.random.default_rng(5)
    values = (rng.integers(0, 400, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(4)
    filters = []
    for part in np.array_split(values, 7):
        distinct, counts = np.unique(part, return_counts=True)
        filters.append(CountingQuotientFilter.of(0, 4, distinct, counts))
    merged = CountingQuotientFilter.merge(filters)
    distinct, counts = np.unique(values, return_counts=True)
    assert np.array_equal(merged.fingerprints, distinct)
    assert np.array_equal(merged.counts, counts)
    assert np.array_equal(merged.repeated(), distinct[counts > 1])
    assert merged.runs.sum() == len(distinct)
