import re

import pytest

from cohortvec.llm.line_dedup import remove_repeated_runs

from .test_line_dedup import rows, rows_of  # noqa: F401


def brute(rows):
    """Ids must differ, but for rows that repeat id and text."""
    seen, done = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            if pair in seen:
                gone |= {i, i + 1}
            seen.add(pair)
        spans = tuple(zip(sorted(gone - {i + 1 for i in gone}), sorted({i + 1 for i in gone} - gone)))
        kept = [x for i, x in enumerate(lines) if i not in gone]
        done[doc_id, text] = (doc_id, len(lines), len(gone), spans, "\n".join(kept))
    return sorted((done[row] for row in rows), key=repr)


@pytest.mark.parametrize("broadcast_rows", [500_000, -1])
def test_against_brute_force(documents, rows, broadcast_rows):  # noqa: F811
    assert rows_of(remove_repeated_runs(documents(rows), broadcast_rows=broadcast_rows)) == brute(rows)


def test_every_repeated_passage_goes(documents):
    """Passages of two lines between lines of their own, wherever chunks would be cut."""
    passages = [f"first {k}\nsecond {k}" for k in range(50)]
    docs = [(1, "\n".join(f"{p}\nbetween {k}" for k, p in enumerate(passages)))]
    docs += [(10 + k, f"before {k}\n{p}\nafter {k}\nsecond {k}") for k, p in enumerate(passages)]
    for r in remove_repeated_runs(documents(docs)).collect():
        k = r.doc_id - 10
        if k >= 0:
            assert [tuple(s) for s in r.removed] == [(1, 3)] and r.kept_text == f"before {k}\nafter {k}\nsecond {k}"
        else:
            assert r.n_removed == 0 and r.kept_text == docs[0][1]


def test_empty_table_and_plan(documents, rows):  # noqa: F811
    assert remove_repeated_runs(documents([])).collect() == []
    plan = remove_repeated_runs(documents(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
