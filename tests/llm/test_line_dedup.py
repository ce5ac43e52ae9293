import hashlib
import random
import re

import pytest

from cohortvec.llm.line_dedup import line_chunks, remove_repeated_chunks


def cut(lines, mean, window):
    """Spans of the chunks, by the rolling hash written out."""
    hashes = [int(hashlib.md5(line.encode()).hexdigest()[:7], 16) for line in lines]
    spans, begin = [], 0
    for i in range(len(lines)):
        rolled = sum(31**k * hashes[i - k] for k in range(window) if i >= k)
        if rolled % mean == 0 or i == len(lines) - 1:
            spans.append((begin, i + 1))
            begin = i + 1
    return spans


def brute(rows, mean=4, window=2):
    """Ids must differ, but for rows that repeat id and text."""
    seen, done, out = set(), {}, []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [] if text is None else text.split("\n")
        gone = []
        for begin, end in cut(lines, mean, window):
            chunk = "\n".join(lines[begin:end])
            if end - begin > 1 and chunk in seen:
                gone.append((begin, end))
            seen.add(chunk)
        out_of = {i for a, b in gone for i in range(a, b)}
        kept = [x for i, x in enumerate(lines) if i not in out_of]
        done[doc_id, text] = (doc_id, len(lines), sum(b - a for a, b in gone), tuple(gone), "\n".join(kept))
    for row in rows:
        out.append(done[row])
    return sorted(out, key=repr)


def rows_of(df):
    got = df.collect()
    return sorted(((r.doc_id, r.n_lines, r.n_removed, tuple(tuple(s) for s in r.removed), r.kept_text) for r in got), key=repr)


@pytest.fixture(scope="module")
def rows(long_text):
    rng = random.Random(6)
    lines = [f"line {i}" for i in range(30)] + ["", "É"]
    passages = [rng.choices(lines, k=12) for _ in range(4)]
    out = [(1000, None), (1001, ""), (1002, "\n\n\n"), (1003, "one"), (1004, "one"), (None, "\n".join(passages[0]))]
    out += [(1005, long_text.replace(" ", "\n")), (1006, "x\n" + long_text.replace(" ", "\n"))]
    for i in range(120):
        text = rng.choices(lines, k=rng.randrange(6)) + rng.choice(passages) + rng.choices(lines, k=rng.randrange(6))
        out.append((i, "\n".join(text)))
    return [*out, out[-1], out[-1]]


@pytest.mark.parametrize(("mean", "window"), [(4, 2), (2, 3), (7, 1)])
def test_against_brute_force(documents, rows, mean, window):
    got = remove_repeated_chunks(documents(rows), mean_lines=mean, window_lines=window)
    assert rows_of(got) == brute(rows, mean, window)


def test_joins_by_shuffle_give_the_same(documents, rows):
    assert rows_of(remove_repeated_chunks(documents(rows), broadcast_rows=-1)) == brute(rows)


def test_cuts_do_not_shift(documents):
    body = "\n".join(f"text {i}" for i in range(200))
    chunks = line_chunks(documents([(1, body), (2, "new first line\n" + body)])).collect()
    own, shifted = ([r.chunk for r in sorted(chunks, key=lambda r: r.start) if r.doc_key == d] for d in (1, 2))
    assert len(own) > 20 and len(set(own) & set(shifted)) >= len(own) - 2


def test_rows_that_share_an_id_keep_one_copy(documents):
    lines = [f"t{i}" for i in range(60)]
    text = "\n".join(lines)
    got = remove_repeated_chunks(documents([(1, text), (1, text + "\nend"), (1, "z\n" + text)])).collect()
    assert sum(r.n_removed for r in got) > 60
    assert {x for r in got for x in r.kept_text.split("\n")} == {*lines, "z", "end"}


def test_empty_table_and_plan(documents, rows):
    assert remove_repeated_chunks(documents([])).collect() == []
    plan = remove_repeated_chunks(documents(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
