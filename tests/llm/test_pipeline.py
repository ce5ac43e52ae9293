"""The pipeline over a small folder, stage by stage against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortvec.llm.toxicity import fit_toxicity, score_toxicity
from cohortvec.session import store

from .test_decontamination import brute as brute_contamination
from .test_exact_dedup import brute as brute_copies
from .test_jaccard_join import brute as brute_groups

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, long_text):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(5)] + [(7, None)]
    docs, labels = [], []
    for i in range(400):
        text = rng.choices(words, k=rng.randrange(5, 70))
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(len(text))] = "scum"
            text[rng.randrange(len(text))] = "idiot"
        if i % 17 == 3:
            text[3:3] = items[i % 5][1].split()
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int("scum" in text or "idiot" in text)))
    for i in range(60):
        base = docs[rng.randrange(400)][1].split()
        if i % 2:
            base[rng.randrange(len(base))] = "changed"
        docs.append((1000 + i, " ".join(base)))
    docs += [(2000, None), (2001, ""), (2002, long_text), (2003, long_text), (2004, "!"), (2004, "!")]
    labels += [(2000, 1, 0), (2001, 1, None), (None, 1, 1)]
    root = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages(spark, folder):
    root, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = {}
    for name, stage in stages.items():
        kept[name] = store(stage(spark, docs, root), "stage").df
        if name != "packing":
            assert kept[name].schema.simpleString() == docs.schema.simpleString()
            docs = kept[name]
    docs = spark.read.parquet(f"{root}/documents.parquet")

    model = fit_toxicity(docs, spark.read.parquet(f"{root}/labels.parquet"))
    clean = pairs(score_toxicity(docs, model).filter("predicted = 0"))
    assert pairs(kept["toxicity"]) == clean
    rude = [(i, t) for i, t in pairs(docs) if t and {"scum", "idiot"} & set(t.split())]
    assert len(set(rude) & set(clean)) <= 0.1 * len(rude)
    assert len(set(pairs(docs)) - set(rude) - set(clean)) <= 2

    single = sorted((row for row, out in zip(sorted(clean, key=repr), _aligned(clean, brute_copies(clean)), strict=True) if out[3]), key=repr)
    assert pairs(kept["exact dedup"]) == single
    groups = _aligned(single, brute_groups(single))
    apart = sorted((row for row, out in zip(single, groups, strict=True) if out[2] == row[0]), key=repr)
    assert pairs(kept["n-gram Jaccard join"]) == apart
    found = _aligned(apart, brute_contamination(apart, items, 13))
    rest = sorted((row for row, out in zip(apart, found, strict=True) if not out[5]), key=repr)
    assert pairs(kept["benchmark decontamination"]) == rest
    assert len(rest) < len(apart) < len(single) < len(clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = kept["packing"].collect()
    tokens = {i: [] for i, _ in rest}
    for r in packed:
        tokens[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, text in dict(rest).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(x == i for x, _ in rest)
        assert sum(n for _, n, _ in tokens[i]) == copies * len(ids)
        assert {zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in tokens[i]} == {c for *_, c in tokens[i]}


def _aligned(rows, results):
    """Results in the order of the rows: both sorted, one result per row."""
    by_id = {}
    for result in results:
        by_id.setdefault(result[0], []).append(result)
    return [by_id[i].pop(0) for i, _ in sorted(rows, key=repr)]


def test_run_equals_its_stages(spark, folder):
    root, _ = folder
    rows = corpus_pipeline.run(spark, root)
    assert rows.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    assert rows.agg({"length": "sum"}).first()[0] > 0


def test_empty_documents(spark, folder, tmp_path):
    root, _ = folder
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
