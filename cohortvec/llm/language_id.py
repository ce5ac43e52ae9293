"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed subwords (runs of three and
of five bytes, white space as one blank); a linear softmax on that mean names
the language.  Both are trained by stochastic gradient descent in numpy.  As
everything up to the softmax is linear, embeddings and output weights fold into
one small table of subword scores, which is all the tasks need.

A temperature fitted on rows left out of training calibrates the scores; the
rejection threshold is the lowest score from which on those rows are right as
often as asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import bound_batches
from .words import LOWER, SPACE, U64, groups_of_rows, string_bytes

HASH_BITS = 15
DIMENSIONS = 16
# Labelled rows of each language that a model is fitted on, at most about.
LANGUAGE_ROWS = 1000
# Besides every whole text, a short piece of it is an example.
SHORT_BYTES = 48
SUBWORDS = (3, 5)
UNKNOWN = "und"

_CLEAN = LOWER.copy()
_CLEAN[SPACE] = 0x20


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # (subwords, languages), already divided by the temperature
    offset: np.ndarray
    reject_below: float


def _subwords(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword numbers at every byte, and the bounds of each text in them.

    The bytes end with ``size`` more blanks, so that the shortest text has one.
    """
    padded = np.concatenate([raw, np.full(size, 0x20, np.uint8)])
    n = len(raw)
    value = padded[:n].astype(U64)
    for k in range(1, size):
        value |= padded[k : n + k].astype(U64) << U64(8 * k)
    number = (value * U64(0x9E3779B97F4A7C15 + 2 * size)) >> U64(64 - HASH_BITS)
    # a subword that runs over the end of its text would show the next one
    lengths = np.diff(offsets)
    ends = np.where(lengths >= size, offsets[1:] - size + 1, offsets[:-1] + np.minimum(lengths, 1))
    return number.astype(np.int32), ends


def _spread(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned bytes with a run of blanks before and after every text, and the offsets."""
    raw, offsets = string_bytes(texts)
    pad = max(SUBWORDS)
    lengths = np.diff(offsets)
    out = np.full(len(raw) + pad * len(lengths), 0x20, np.uint8)
    place = np.arange(len(raw)) + np.repeat(np.arange(len(lengths)) * pad + 1, lengths)
    out[place] = _CLEAN[raw]
    return out, np.concatenate([[0], np.cumsum(lengths + pad)])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct subwords and their shares, of whole texts and of short pieces."""
    for batch in batches:
        for part in groups_of_rows(batch, "text"):
            rows = []
            for text, lang, place in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "place")), strict=True):
                at = place % max(len(text) - SHORT_BYTES, 1)
                for kind, piece in enumerate((text, text[at : at + SHORT_BYTES])):
                    raw, offsets = _spread(pa.array([piece]))
                    found = []
                    for size in SUBWORDS:
                        number, ends = _subwords(raw, offsets, size)
                        found.append(number[: ends[0]])
                    number, counts = np.unique(np.concatenate(found), return_counts=True)
                    shares = (counts / counts.sum()).astype("<f4")
                    rows.append((lang, place, kind, number.astype("<i4").tobytes(), shares.tobytes()))
            lang, place, kind, number, shares = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(place, pa.int64()), pa.array(kind, pa.int32()),
                 pa.array(number, pa.binary()), pa.array(shares, pa.binary())],
                ["lang", "place", "kind", "number", "shares"],
            )


def fit_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    language_rows: int = LANGUAGE_ROWS,
    rounds: int = 4,
    rate: float = 0.5,
    right: float = 0.95,
) -> LanguageModel:
    """Model from the labelled rows of ``docs``, at most about ``language_rows`` a language.

    The draw follows a hash of id and text, the same on any partitioning.
    Rows without text or language are left out.  Without any, every text is
    unknown.  ``right`` is the share of right answers above the rejection
    threshold.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((1 << HASH_BITS, 0)), np.zeros(0), 1.0)
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(language_rows / counts[k], 1.0))])
    place = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 30))
    drawn = rows.withColumn("place", place).filter(F.col("place") < share[F.col("lang")] * (1 << 30))
    sample = (
        drawn.select("text", "lang", "place")
        .mapInArrow(_examples, "lang string, place bigint, kind int, number binary, shares binary")
        .toArrow()
        .sort_by([("place", "ascending"), ("kind", "ascending"), ("lang", "ascending")])
    )
    y = np.searchsorted(languages, sample.column("lang").to_pylist())
    x = [
        (np.frombuffer(n, "<i4"), np.frombuffer(s, "<f4"))
        for n, s in zip(sample.column("number").to_pylist(), sample.column("shares").to_pylist(), strict=True)
    ]
    # neighbours in the order share a text: whole texts are left out, not pieces
    out = np.asarray(sample.column("place")) % 5 == 0
    embedding, weights, bias = _descend([a for a, o in zip(x, out, strict=True) if not o], y[~out], len(languages), rounds, rate)
    scores = embedding @ weights
    logits = np.array([s @ scores[n] for (n, s), o in zip(x, out, strict=True) if o]).reshape(-1, len(languages)) + bias
    temperature, reject_below = _calibrate(logits, y[out], right)
    return LanguageModel(languages, (scores / temperature).astype(np.float32), bias / temperature, reject_below)


def _descend(x: list, y: np.ndarray, classes: int, rounds: int, rate: float):
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 0.1, (1 << HASH_BITS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, classes)), np.zeros(classes)
    seen = np.maximum(np.bincount(y, minlength=classes), 1)
    balance = len(y) / (classes * seen)  # a rare language counts as much as a common one
    for k in range(rounds):
        step = rate * (1 - k / rounds)
        for i in rng.permutation(len(y)):
            number, share = x[i]
            mean = share @ embedding[number]
            gradient = _softmax(mean @ weights + bias)
            gradient[y[i]] -= 1
            gradient *= step * min(balance[y[i]], 10)
            back = weights @ gradient
            weights -= np.outer(mean, gradient)
            bias -= 0.1 * gradient
            # shares are tiny; dividing by their root keeps rare subwords moving
            embedding[number] -= np.outer(np.sqrt(share), back)
    return embedding, weights, bias


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrate(logits: np.ndarray, y: np.ndarray, right: float) -> tuple[float, float]:
    """Temperature of least loss, and the score above which enough answers are right."""
    if not len(y):
        return 1.0, 0.5
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    scores = _softmax(logits / temperature)
    best = scores.max(axis=1)
    order = np.argsort(-best)
    rights = np.cumsum((scores.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    enough = np.flatnonzero(rights >= right)
    return temperature, float(best[order[enough[-1]]]) if len(enough) else 1.0


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Whole texts are read.  A null text or one without a letter is ``und`` with
    score 0 and rejected.  ``rejected`` marks scores below the calibrated
    threshold; the language stays readable.  New columns replace old ones of
    the same name.
    """
    new = ("lang_pred", "score", "rejected", "_letter")
    kept = [f for f in docs.schema if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of_rows(batch, text_col, 1 << 20):
                score, best = _scores(model, part.column(text_col))
                known = np.asarray(part.column("_letter")) & (len(model.languages) > 0)
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
                columns = {f.name: part.column(f.name) for f in kept}
                columns["lang_pred"] = pa.array(names, pa.string())
                columns["score"] = pa.array(score, pa.float64())
                columns["rejected"] = pa.array(~known | (score < model.reject_below), pa.bool_())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    bound_batches(docs.sparkSession)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string, score double, rejected boolean"])
    return docs.select(*[f"`{f.name}`" for f in kept], letter.alias("_letter")).mapInArrow(run, schema)


def _scores(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of the best language of every text."""
    if not model.languages:
        return np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    raw, offsets = _spread(texts)
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros((len(texts), 1))
    step = 1 << 18  # subwords at a time
    for size in SUBWORDS:
        number, ends = _subwords(raw, offsets, size)
        for a in range(0, len(number), step):
            sums = np.concatenate(
                [np.zeros((1, len(model.languages))), np.cumsum(model.scores[number[a : a + step]], axis=0, dtype=np.float64)]
            )
            low, high = (np.clip(x - a, 0, len(sums) - 1) for x in (offsets[:-1], ends))
            total += sums[high] - sums[low]
        count += (ends - offsets[:-1])[:, None]
    chances = _softmax(total / np.maximum(count, 1) + model.offset)
    return chances.max(axis=1), chances.argmax(axis=1)
