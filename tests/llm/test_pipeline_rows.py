"""Stages that drop documents, over null and repeated ids."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id bigint, text string, source string"
ITEM = " ".join(f"item{k}" for k in range(20))


@pytest.fixture(scope="module")
def text():
    rng = random.Random(4)
    return lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))


@pytest.fixture
def left(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, rows):
        docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], COLUMNS)
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    return run


def test_contaminated_rows_go_by_id_and_text(left, text):
    clean, unnamed = text(), text()
    rows = [(None, ITEM), (None, unnamed), (None, None), (5, ITEM + " end"), (5, clean), (-(1 << 63), unnamed)]
    kept = [(None, unnamed), (None, None), (5, clean), (-(1 << 63), unnamed)]
    assert left(corpus_pipeline.decontamination, rows) == sorted(kept, key=repr)


def test_equal_texts_leave_one_row(left, text):
    a, b, c = text(), text(), text()
    rows = [(None, a), (None, a), (None, b), (4, b), (4, c), (9, b), (None, None), (None, ""), (-(1 << 63), c), (None, c)]
    got = left(corpus_pipeline.exact_dedup, rows)
    assert sorted(((i, t or "") for i, t in got), key=repr) == sorted([(None, a), (None, ""), (9, b), (4, c)], key=repr)


def test_near_copies_leave_one_row(left, text):
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a + " x"), (3, a), (None, b), (None, b + " y"), (7, c), (7, c + " z"), (3, d), (8, d + " u")]
    got = left(corpus_pipeline.near_dedup, rows)
    assert len(got) == 4 and {(3, a), (3, d)} < set(got)
    assert len({(None, b), (None, b + " y")} & set(got)) == 1
    assert len({(7, c), (7, c + " z")} & set(got)) == 1


def test_columns_named_like_those_inside(spark, tmp_path, text):
    """Every column keeps its values, whatever its name."""
    names = ["_gone_key", "_Gone_Key_", "_row", "_score", "_predicted", "key", "n", "sid", "_group"]
    texts = [text() for _ in range(6)] + [ITEM + " end"]
    rows = [(i, t, *range(k * 10, k * 10 + len(names))) for k, (i, t) in enumerate([*enumerate(texts), (9, texts[0]), (10, texts[1] + " x")])]
    columns = ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {columns}")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 0) for i in range(6)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = {"toxicity": set(), "exact_dedup": {0}, "near_dedup": {9, 10}, "decontamination": {6}}
    for stage, ids in gone.items():
        out = getattr(corpus_pipeline, stage)(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        assert sorted(map(tuple, out.collect())) == sorted(r for r in rows if r[0] not in ids)
