import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortvec.llm import fill_in_middle as f
from cohortvec.llm.words import string_bytes


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\0é漢😀", max_size=40))
def test_places_of_code_points(text):
    index = f.ByteIndex(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    places = [len(text[:i].encode()) for i in points]
    assert index.bytes_at(points).tolist() == places
    assert index.points_at(np.array(places)).tolist() == points.tolist()
    assert len(index.points) == sum(c > "\x7f" for c in text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["<", "P", "S", "M", ">", "<P>", "é"]), max_size=6).map("".join)), max_size=8))
def test_marks_inside_one_text(texts):
    got = f.has_mark(*string_bytes(pa.array(texts, pa.string())))
    assert got.tolist() == [any(m in (t or "") for m in ("<P>", "<S>", "<M>")) for t in texts]


def plain_rule(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rows(spark, documents, long_text):
    special = [None, "", "a", "é", "<P", "x<S>y", "<M", "<" * 50, "<S<S<P", long_text, "漢" * 5000, "a\0b"]
    rows = [(i, special[i % len(special)]) for i in range(400)] + [(None, "no id here"), (7, "x"), (7, "x")]
    got = f.restore_texts(f.fill_in_middle(documents(rows))).collect()
    want = sorted(repr((i, *plain_rule(i, t), t or "")) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_shares_and_seed(spark, documents):
    docs = documents([(i, "some text of a few words") for i in range(3000)])
    forms = [r.form for r in f.fill_in_middle(docs, plain_percent=50, spm_percent=50).select("form").collect()]
    assert 0.45 < forms.count("plain") / 3000 < 0.55
    assert 0.2 < forms.count("spm") / 3000 < 0.3
    one, two = (f.fill_in_middle(docs, seed=s).select("output").collect() for s in (1, 2))
    assert one != two


def test_empty_table_and_errors(spark, documents):
    arranged = f.fill_in_middle(documents([]))
    assert f.restore_texts(arranged).collect() == []
    with pytest.raises(ValueError, match="already"):
        f.restore_texts(arranged, restored_col="n")
    assert f.rebuild(b"<P><<S>b<M>c", "psm") == b"<cb"
    with pytest.raises(ValueError, match="unknown form"):
        f.rebuild(b"x", None)
    nothing = spark.createDataFrame([(None, "psm")], "output string, form string")
    assert f.restore_texts(nothing).first().restored is None
