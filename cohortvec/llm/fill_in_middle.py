"""Fill-in-the-middle order of training texts.

A text is cut at two code points into prefix, middle and suffix, and put out as
prefix, suffix, middle or as suffix, prefix, middle, each part behind its mark.
Texts stay UTF-8 bytes.  A sparse index records the multibyte characters alone,
by position and excess bytes; a binary search in it turns code points into bytes
and back, and between its entries positions differ by a constant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizes import bound_batches
from .words import groups_of_rows, string_bytes

# The marks before prefix, suffix and middle.  No mark ends as
# another begins, so the first place of each in an output is the one put there.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class ByteIndex:
    """Code points and bytes of UTF-8 text; holds an entry per multibyte character."""

    def __init__(self, raw: np.ndarray) -> None:
        self.places = np.flatnonzero(raw >= 0xC0)
        first = raw[self.places]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.points = self.places - self.excess[:-1]

    def bytes_at(self, points: np.ndarray) -> np.ndarray:
        """Places of code points, the one after the last included."""
        return points + self.excess[np.searchsorted(self.points, points)]

    def points_at(self, places: np.ndarray) -> np.ndarray:
        """Code points before places where a character begins or the text ends."""
        return places - self.excess[np.searchsorted(self.places, places)]


def draws(keys: list[bytes]) -> np.ndarray:
    """Four unsigned 32-bit numbers per key: the first 16 bytes of its SHA-256."""
    digests = b"".join(hashlib.sha256(key).digest()[:16] for key in keys)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def has_mark(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text contains one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(raw[:-2] == PREFIX[0])
    inner = np.isin(raw[at + 1], [mark[1] for mark in (PREFIX, SUFFIX, MIDDLE)])
    at = at[inner & (raw[at + 2] == PREFIX[2])]
    text = np.searchsorted(offsets, at, "right") - 1
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """Per row ``doc_id``, code points ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The four draws of a row come from the SHA-256 of ``seed:id``: both cuts
    (modulo n + 1), the share of texts left plain and the share of the others
    with the suffix first.  Rows that repeat an id get the same draws; a null id
    counts as nothing after the colon.  Null or empty text, and text that holds a
    mark, stays plain, with null cuts.  Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of_rows(batch, "text"):
                yield arrange(part)

    def arrange(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = string_bytes(part.column(2))
        index = ByteIndex(raw)
        points = index.points_at(offsets)
        n = np.diff(points)
        h = draws([key.encode() for key in part.column(1).to_pylist()])
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        plain = (n == 0) | has_mark(raw, offsets) | (h[:, 2] % 100 >= 100 - plain_percent)
        suffix_first = h[:, 3] % 100 < spm_percent
        a, b = index.bytes_at(points[:-1] + cuts[:, 0]).tolist(), index.bytes_at(points[:-1] + cuts[:, 1]).tolist()
        data, begins, ends = raw.tobytes(), offsets[:-1].tolist(), offsets[1:].tolist()
        forms, outputs = [], []
        for i, (is_plain, is_spm) in enumerate(zip(plain.tolist(), suffix_first.tolist(), strict=True)):
            prefix, middle, suffix = data[begins[i] : a[i]], data[a[i] : b[i]], data[b[i] : ends[i]]
            if is_plain:
                forms.append(PLAIN)
                outputs.append(data[begins[i] : ends[i]])
            elif is_spm:
                forms.append(SPM)
                outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
            else:
                forms.append(PSM)
                outputs.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
        columns = [
            part.column(0),
            pa.array(n, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(cuts[:, 0], pa.int64(), mask=plain),
            pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bound_batches(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "n bigint, form string, prefix_chars bigint, middle_chars bigint"
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, output string")


def rebuild(output: bytes, form: str) -> bytes:
    """The text an output was made of; needs nothing else than its form."""
    if form == PLAIN:
        return output
    if form not in (PSM, SPM):
        raise ValueError(f"unknown form {form!r}")
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    before = output.index(second)
    after = output.index(MIDDLE, before)
    parts = {first: output[len(first) : before], second: output[before + len(second) : after]}
    return parts[PREFIX] + output[after + len(MIDDLE) :] + parts[SUFFIX]


def restore_texts(
    rows: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored"
) -> DataFrame:
    """``rows`` with the texts rebuilt from outputs and forms in a new column ``restored_col``.

    A null output gives null; a null or unknown form is an error, as is a
    column of that name that is already there.
    """
    if restored_col in rows.columns:
        raise ValueError(f"there is a column {restored_col!r} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of_rows(batch, output_col):
                outputs = part.column(output_col).cast(pa.binary()).to_pylist()
                forms = part.column(form_col).to_pylist()
                texts = [None if o is None else rebuild(o, f) for o, f in zip(outputs, forms, strict=True)]
                yield part.append_column(restored_col, pa.array(texts, pa.binary()).cast(pa.string()))

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(restored_col, T.StringType())]))
