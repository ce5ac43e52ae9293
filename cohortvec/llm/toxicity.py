"""Toxicity scores by FTRL-proximal logistic regression.

Features are the distinct hashed words, word pairs and skip-grams (a word and
the next but one) of a whole text.  Training keeps a learning rate for every
coordinate, and its L1 term leaves most weights at exactly zero, so the model
that travels to the tasks is a short list of hashes and weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import bound_batches
from .words import U64, Words, groups_of_rows, mix, split_words

HASH_BITS = 20
# Labelled rows of each class that a model is fitted on, at most about.
CLASS_ROWS = 4000
THRESHOLD = 0.3

# words end at any ASCII character that is neither letter nor digit
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights by feature number, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << HASH_BITS, np.float32)
        table[self.features] = self.weights
        return table


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature number) of words, pairs and skip-grams."""
    shift, of = U64(64 - HASH_BITS), words.text_of
    yield of, (words.hash >> shift).astype(np.int32)
    for gap in (1, 2):
        same = of[:-gap] == of[gap:]
        pairs = mix(words.hash[:-gap] * U64(2 * gap + 1) + words.hash[gap:])
        yield of[:-gap][same], (pairs >> shift).astype(np.int32)[same]


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in groups_of_rows(batch, "text"):
            words = split_words(part.column("text"), lower=True, space=BREAKS)
            of, number = (np.concatenate(x) for x in zip(*_features(words), strict=True))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(part.num_rows + 1))
            lists = [np.unique(number[order[a:b]]).astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [part.column("toxic"), part.column("place"), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "place", "features"])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    class_rows: int = CLASS_ROWS,
    rounds: int = 3,
    min_rows: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 5.0,
    l2: float = 1.0,
) -> ToxicityModel:
    """Model from labelled rows; at most about ``class_rows`` of each class.

    The rows are drawn by a hash of their id, so the draw is the same on any
    partitioning, and the intercept is corrected for the shares drawn.  Never more
    than ``4 * class_rows`` rows are taken, however many share an id.  Rows
    without id, text or label are left out; of several labels of one id the
    larger counts.  Features of fewer than ``min_rows`` drawn rows are left out.
    Without any row of class 1 every score is 0.
    """
    bound_batches(docs.sparkSession)
    ids = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1))
    )
    counts = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), -math.inf)
    place = F.xxhash64(F.lit("draw"), F.col("doc_id"))
    share = F.when(F.col("toxic") == 1, class_rows / counts[1]).otherwise(class_rows / max(counts.get(0, 0), 1))
    drawn = ids.withColumn("place", place).filter(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
    # about 2 * class_rows rows, whatever the size of the tables
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna()
    # a limit for rows that share a drawn id; texts stay on the executors
    sample = (
        rows.join(F.broadcast(drawn), "doc_id")
        .select("text", "toxic", "place")
        .mapInArrow(_training_features, "toxic int, place bigint, features binary")
        .orderBy("place", "features")
        .limit(4 * class_rows)
        .toArrow()
    )
    y = np.asarray(sample.column("toxic"), np.float64)
    if not y.any():
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), -math.inf)
    flat, ends = _flat_features(sample.column("features"))
    del sample
    flat, ends = _common(flat, ends, min_rows)
    x = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    weights, bias = _ftrl(x, y, rounds, alpha, beta, l1, l2)
    drawn_odds = y.sum() / max(len(y) - y.sum(), 1)
    bias += math.log(counts[1] / max(counts.get(0, 0), 1)) - math.log(drawn_odds)
    kept = np.flatnonzero(weights)
    return ToxicityModel(kept.astype(np.int32), weights[kept].astype(np.float32), bias)


def _flat_features(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows in one array, and where each row begins and the last ends.

    An array for each row would stay with the driver: small pieces of memory are
    not given back.
    """
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(lists).to_numpy().astype(np.int64) // 4)])
    flat, at = np.empty(ends[-1], "<i4"), 0
    for chunk in lists.chunks:
        _, offsets, data = chunk.buffers()
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        bounds = np.frombuffer(offsets, kind)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and bounds[-1] > bounds[0]:
            part = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view("<i4")
            flat[at : at + len(part)] = part
            at += len(part)
    return flat, ends


def _common(flat: np.ndarray, ends: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without features of fewer than ``min_rows`` rows."""
    rows_with, parts = np.zeros(1 << HASH_BITS, np.int64), range(0, len(flat), 1 << 20)
    for a in parts:  # numpy widens what it counts or looks up
        rows_with += np.bincount(flat[a : a + (1 << 20)], minlength=1 << HASH_BITS)
    common, kept = rows_with >= min_rows, np.empty(len(flat), bool)
    for a in parts:
        kept[a : a + (1 << 20)] = common[flat[a : a + (1 << 20)]]
    return flat[kept], np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[ends]


def _ftrl(
    x: list[np.ndarray], y: np.ndarray, rounds: int, alpha: float, beta: float, l1: float, l2: float
) -> tuple[np.ndarray, float]:
    """FTRL-proximal (McMahan et al. 2013), one example at a time; no penalty on the intercept."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((beta + np.sqrt(n)) / alpha + l2))

    def intercept() -> float:
        return -bias_z * alpha / (beta + math.sqrt(bias_n))

    for _ in range(rounds):
        for features, label in zip(x, y, strict=True):
            w, b = weight(z[features], n[features]), intercept()
            g = _sigmoid(w.sum() + b) - label
            step = (np.sqrt(n[features] + g * g) - np.sqrt(n[features])) / alpha
            z[features] += g - step * w
            n[features] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    return weight(z, n), intercept()


def _sigmoid(v):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-v))


def _text_scores(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    words = split_words(texts, lower=True, space=BREAKS)
    hits = []
    for of, number in _features(words):
        hit = np.flatnonzero(table[number])
        hits.append((of[hit] << HASH_BITS) | number[hit])
    # each feature of a text counts once
    hits = np.unique(np.concatenate(hits))
    return _sigmoid(bias + np.bincount(hits >> HASH_BITS, table[hits & ((1 << HASH_BITS) - 1)], minlength=len(texts)))


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The score of a text, 0 to 1, as a column; the other columns of its row stay where they are."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.dense()
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            parts = [_text_scores(p.column(0), table, model.bias) for p in groups_of_rows(batch, "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(score, "double")(text)


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    text_col: str = "text",
    score_col: str = "score",
    threshold: float = THRESHOLD,
    predicted_col: str = "predicted",
) -> DataFrame:
    """All columns of ``docs`` plus the score (0 to 1) and whether it reaches ``threshold`` (1 or 0).

    A text is scored whole; null and empty texts get the score of no features.
    New columns replace old ones of the same name; repeated rows score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for batch in batches:
            for part in groups_of_rows(batch, text_col):
                score = _text_scores(part.column(text_col), table, model.bias)
                kept = {c: part.column(c) for c in part.schema.names if c not in (score_col, predicted_col)}
                kept[score_col] = pa.array(score, pa.float64())
                kept[predicted_col] = pa.array((score >= threshold).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(list(kept.values()), list(kept))

    bound_batches(docs.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (score_col, predicted_col)]
    return docs.mapInArrow(run, ", ".join([*kept, f"`{score_col}` double", f"`{predicted_col}` int"]))
