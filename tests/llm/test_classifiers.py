import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortvec.llm import language_id as li
from cohortvec.llm import toxicity as tx
from cohortvec.llm.words import mix, split_words

SYLLABLES = {"en": ["the", "ing", "th", "er", "sh"], "fr": ["eau", "oui", "le", "é", "ai"], "de": ["sch", "ung", "ei", "ß", "ü"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, long_text):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        lang = rng.choice(list(SYLLABLES))
        toxic = int(rng.random() < 0.2)
        text = sentence(rng, lang, rng.randrange(3, 80)).split()
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Idiot!", "scum", "moron,"]))
        rows.append((i, " ".join(text), lang, toxic, "s", 0.5))
    rows += [(5000, None, "en", 1, "s", 0.5), (5001, "", "fr", 0, "s", 0.5), (5002, "12 34 !?", "de", 0, "s", 0.5),
             (5003, long_text, None, None, "s", 0.5), (None, "the sher", "en", 0, "s", 0.5), (5004, "É", "fr", 0, "s", 0.5)]
    rows += rows[:3]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int, score string, predicted double").persist()


def test_languages_of_held_out_rows(corpus):
    model = li.fit_languages(corpus.filter("doc_id % 5 <> 0"))
    rows = li.predict_language(corpus, model).collect()
    assert len(rows) == corpus.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 5000 and r.doc_id % 5 == 0]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id in (5000, 5001, 5002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in SYLLABLES
    assert {r.lang_pred for r in rows if r.doc_id == 5004} == {"fr"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1


def test_text_scores_do_not_depend_on_neighbours(corpus):
    import pyarrow as pa

    model = li.fit_languages(corpus)
    texts = ["the sher", "", None, "é", "ungeisch schung ei", "ab"]
    together = li._scores(model, pa.array(texts, pa.string()))[0]
    alone = [li._scores(model, pa.array([t], pa.string()))[0][0] for t in texts]
    assert np.allclose(together, alone)


def test_unlabelled_and_empty_tables(corpus):
    model = li.fit_languages(corpus.filter("lang = 'xx'"))
    assert {r.lang_pred for r in li.predict_language(corpus.limit(5), model).collect()} == {"und"}
    assert li.predict_language(corpus.limit(0), model).collect() == []


def test_rejection_follows_calibration():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3))
    logits[np.arange(4000), y] += np.where(rng.random(4000) < 0.5, 4, 0)
    temperature, threshold = li._calibrate(3 * logits, y, 0.9)
    scores = li._softmax(3 * logits / temperature)
    sure = scores.max(axis=1) >= threshold
    assert 0.1 < sure.mean() < 0.9
    assert (scores.argmax(axis=1) == y)[sure].mean() >= 0.9
    assert abs(scores.max(axis=1).mean() - (scores.argmax(axis=1) == y).mean()) < 0.03


def test_toxicity_of_held_out_rows(corpus):
    model = tx.fit_toxicity(corpus, corpus.filter("doc_id % 4 <> 2").select("doc_id", "toxic"))
    assert len(model.features) < 500  # L1 leaves few weights
    rows = tx.score_toxicity(corpus, model).collect()
    assert len(rows) == corpus.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 5000 and r.doc_id % 4 == 2]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5000, 5001)}) == 1
    assert "lang" in rows[0].asDict()


def plain_features(text):
    """Distinct feature numbers of a text, word by word."""
    words = [x.lower() if x.isascii() else x for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
    hashes = [int(split_words(pa.array([x]), lower=True, space=tx.BREAKS).hash[0]) for x in words]
    out = {h >> (64 - tx.HASH_BITS) for h in hashes}
    for gap in (1, 2):
        for a, b in zip(hashes, hashes[gap:]):
            both = np.array([(a * (2 * gap + 1) + b) % 2**64], np.uint64)
            out.add(int(mix(both)[0]) >> (64 - tx.HASH_BITS))
    return out


def test_scores_equal_plain_sums(corpus):
    model = tx.fit_toxicity(corpus, corpus.select("doc_id", "toxic"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    rows = [(1, "idiot"), (2, "idiot idiot idiot IDIOT!"), (3, None), (4, ""), (5, "the scum, the moron er"), (6, "É")]
    rows += [(r.doc_id, r.text) for r in corpus.filter("doc_id < 40").collect()]
    scored = tx.score_toxicity(corpus.sparkSession.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    columns = corpus.sparkSession.createDataFrame(rows, "doc_id bigint, text string").withColumn("s", tx.toxicity_score(F.col("text"), model))
    alike = {(r.doc_id, r.text): r.s for r in columns.collect()}
    for r in scored:
        total = model.bias + sum(weights.get(f, 0.0) for f in plain_features(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6)
        assert alike[r.doc_id, r.text] == r.score


def plain_ftrl(x, y, rounds, alpha, beta, l1, l2):
    """The published update, one coordinate at a time; the last coordinate is the intercept."""
    z, n = {}, {}

    def weight(f, free):
        if not free and abs(z.get(f, 0.0)) <= l1:
            return 0.0
        pull = 0.0 if free else math.copysign(l1, z[f])
        return -(z.get(f, 0.0) - pull) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + (0.0 if free else l2))

    for _ in range(rounds):
        for features, label in zip(x, y, strict=True):
            own = {f: weight(f, False) for f in features} | {"b": weight("b", True)}
            g = 1 / (1 + math.exp(-sum(own.values()))) - label
            for f, w in own.items():
                step = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + g - step * w
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f, False) for f in z if f != "b"}, weight("b", True)


def test_training_equals_the_published_update():
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(120)]
    y = np.array([float(3 in f or rng.random() < 0.1) for f in x])
    weights, bias = tx._ftrl(x, y, 3, 1.0, 1.0, 0.7, 1.0)
    want, want_bias = plain_ftrl([f.tolist() for f in x], y, 3, 1.0, 1.0, 0.7, 1.0)
    assert bias == pytest.approx(want_bias)
    assert {f: weights[f] for f in want} == pytest.approx(want)
    assert np.count_nonzero(weights) == sum(w != 0 for w in want.values()) < 30


def test_rows_that_share_an_id_are_bounded(spark):
    rows = [(1, f"some scum {i}", 1) for i in range(3000)] + [(i, f"clean {i}", 0) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = docs.select("doc_id", "toxic").distinct()
    taken = []
    plain = tx._ftrl
    try:
        tx._ftrl = lambda x, y, *a: (taken.append(len(y)), plain(x, y, *a))[1]
        model = tx.fit_toxicity(docs, labels, class_rows=50)
    finally:
        tx._ftrl = plain
    assert taken and taken[0] <= 200
    assert len(model.features)


@pytest.mark.parametrize("labels", ["toxic = 0", "toxic > 5", "toxic = 1"])
def test_one_class_or_none(corpus, labels):
    model = tx.fit_toxicity(corpus, corpus.filter(labels).select("doc_id", "toxic"))
    scores = {r.score for r in tx.score_toxicity(corpus.limit(20), model).collect()}
    assert all(0 <= s <= 1 for s in scores)
    if labels != "toxic = 1":
        assert scores == {0.0}
    assert tx.score_toxicity(corpus.limit(0), model).collect() == []


def test_training_features_are_not_copied_row_by_row():
    lists = [[5, 9, 11], [], [5, 11], [9]]
    packed = [np.array(x, "<i4").tobytes() for x in lists]
    chunks = pa.chunked_array([pa.array([b"", *packed[:2]], pa.binary()).slice(1), pa.array(packed[2:], pa.binary())])
    flat, ends = tx._flat_features(chunks)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == lists
    flat, ends = tx._common(flat, ends, 2)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == lists
    flat, ends = tx._common(flat[:-1], np.minimum(ends, 5), 2)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [[5, 11], [], [5, 11], []]
    empty, ends = tx._flat_features(pa.chunked_array([pa.array([b"", b""], pa.binary())]))
    assert not len(empty) and ends.tolist() == [0, 0, 0]
