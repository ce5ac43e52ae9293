import random
import re

import numpy as np
import pytest

from cohortvec.llm import jaccard_join as j
from cohortvec.llm.jaccard_join import near_duplicate_groups

from .test_words import thue_morse


def shingles(text, size):
    words = [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, size=5):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    root[find(a)] = find(b)
    out = []
    for a, (doc_id, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((doc_id, len(sets[a]), min(ids, default=None)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(long_text):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    out = [
        (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  TWO"), (1005, "one two three"),
        (1006, "É a b c d e"), (1007, "é a b c d e"), (1008, long_text), (1009, long_text.replace("w7919 ", "changed ")),
        (None, "one two"), (None, "alone here"), (1010, "one two"), (1011, "same row twice here now"), (1011, "same row twice here now"),
    ]
    for g in range(25):
        base = rng.choices(words, k=rng.randrange(6, 60))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((rng.randrange(900), " ".join(copy)))
    # one passage that most of these texts share, and a chain of near copies
    passage = " ".join(words[:40])
    out += [(2000 + i, passage + " " + " ".join(rng.choices(words, k=8))) for i in range(40)]
    chain = rng.choices(words, k=80)
    for i in range(30):
        chain[2 * i] = f"edit{i}"
        out.append((3000 - i, " ".join(chain)))
    # variants of one text, each with changes of its own: most reach the others through it
    star = rng.choices(words, k=100)
    for i in range(80):
        variant = list(star)
        for _ in range(i % 6):
            variant[rng.randrange(100)] = f"own{rng.randrange(10**6)}"
        out.append((4000 + i, " ".join(variant)))
    return out


def test_against_all_pairs(documents, rows):
    assert rows_of(near_duplicate_groups(documents(rows))) == brute(rows)


def test_prefixes_find_what_minima_miss(documents, rows, monkeypatch):
    monkeypatch.setattr(j, "MINIMA", 0)
    monkeypatch.setattr(j, "TASK_POSTINGS", 200)
    monkeypatch.setattr(j, "WIDE_TOKEN", 3)
    assert rows_of(near_duplicate_groups(documents(rows))) == brute(rows)


def test_joins_by_shuffle_and_other_orders(documents, rows, monkeypatch):
    monkeypatch.setattr(j, "ORDERS", 3)
    assert rows_of(near_duplicate_groups(documents(rows), broadcast_rows=-1)) == brute(rows)


def test_empty_table(documents):
    assert near_duplicate_groups(documents([])).collect() == []
    only_empty = near_duplicate_groups(documents([(1, None), (2, "")]))
    assert rows_of(only_empty) == [(1, 0, 1), (2, 0, 2)]


def test_bitmap_bound_is_sound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = set(rng.integers(0, 1000, 300).tolist())
        y = set(rng.integers(0, 1000, 300).tolist()) | set(list(x)[:250])
        bits = [{v * 7919 % 256 for v in s} for s in (x, y)]
        assert len(bits[0] ^ bits[1]) <= len(x ^ y)


def test_shingles_of_words_whose_polynomials_agree(documents):
    one, two = thue_morse("a", "b")
    rows = [(1, f"{one} v w x y"), (2, f"{two} v w x y"), (3, f"{one} v w x y")]
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(documents(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
