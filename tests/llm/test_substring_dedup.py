import hashlib
import random
import re

from pyspark.sql import functions as F

from cohortvec.llm.ranges import range_bounds, range_number
from cohortvec.llm.substring_dedup import remove_repeated_windows

from .test_words import thue_morse


def brute(rows, window):
    """Kept words of each row, rows in order of id (null first) and text."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out.append((doc_id, len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone)))
    return out


def check(df, rows, window, **settings):
    got = remove_repeated_windows(df, window=window, **settings).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr)
    assert found == sorted(brute(rows, window), key=repr)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    return got


def test_edge_cases(documents, long_text):
    copy = " ".join(f"t{i}" for i in range(30))
    rows = [
        (5, copy), (3, "x " + copy + " y"), (9, copy), (9, copy), (None, copy), (7, None), (8, ""), (1, " \n\t"),
        (2, "short"), (4, "a " * 60), (6, "É b " * 25), (10, long_text), (11, long_text + " end"),
    ]
    check(documents(rows), rows, 20)


def test_random_texts_in_many_blocks(documents):
    rng = random.Random(3)
    passages = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(6)]
    rows = [
        (rng.randrange(-50, 50), " ".join(rng.choices("abcdefgh", k=rng.randrange(30))) + " " + rng.choice(passages))
        for _ in range(150)
    ]
    df = documents(rows)
    assert len(range_bounds(df, "doc_id", "text", 8192)) > 10
    check(df, rows, 5, block_bytes=8192, range_windows=50)


def test_empty_table(documents):
    assert remove_repeated_windows(documents([])).collect() == []


def test_range_number(spark):
    bounds = [0, 3, 4, 10, 11, 12, 90]
    numbered = spark.range(-2, 100).withColumn("b", range_number(F.col("id"), bounds))
    for r in numbered.collect():
        assert r.b == sum(x <= r.id for x in bounds)


def test_digest_of_query(spark, tmp_path, documents):
    from cohortvec.llm.queries import op1_substring_dedup

    documents([(1, "a\tb  c"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_windows_of_words_whose_polynomials_agree(documents):
    one, two = thue_morse("a", "b")
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, " ".join([one, *rest]))]
    got = {r.doc_id: r.n_removed for r in remove_repeated_windows(documents(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
