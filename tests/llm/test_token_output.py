import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortvec.llm import token_output as t
from cohortvec.llm.token_output import FeistelPermutation, read_positions, write_training_order
from cohortvec.sources.commits import NotCommitted


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
@pytest.mark.parametrize("key", [0, 42, -5])
def test_permutation_is_a_keyed_bijection(size, key):
    order = FeistelPermutation(size, key)
    slots = order.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.number(slots) == np.arange(size)).all()
    if size > 100:
        assert (slots != FeistelPermutation(size, key + 1).slot(np.arange(size))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.2


@pytest.fixture(scope="module")
def texts(long_text):
    return ["one two", None, "", long_text, *(f"text number {i} " * (i % 90) for i in range(200)), "twin", "twin"]


@pytest.fixture(scope="module")
def written(spark, documents, texts, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("order"))
    documents(list(enumerate(texts))).repartition(3).write.parquet(f"{root}/docs")
    write_training_order(spark.read.parquet(f"{root}/docs"), f"{root}/out", key=7, length=64, shard_sequences=30)
    return root


def test_streams_come_back(spark, written, texts):
    layout = t.read_layout(spark, f"{written}/out")
    rows = read_positions(spark, f"{written}/out").collect()
    assert sorted(r.position for r in rows) == list(range(layout.sequences))
    order = FeistelPermutation(layout.sequences, 7)
    by_number = sorted((int(order.number(np.array([r.position]))[0]), r) for r in rows)
    assert [n for n, _ in by_number] == list(range(layout.sequences))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple([*tokenizer.encode(x or "", add_special_tokens=False).ids, 1]) for x in texts)
    stream = []
    for _, r in by_number:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and (ids[r.n_tokens :] == 1).all()
        stream += ids[: r.n_tokens].tolist()
    found, begin = Counter(), 0
    for i, token in enumerate(stream):
        if token == 1:
            found[tuple(stream[begin : i + 1])] += 1
            begin = i + 1
    assert found == want


def test_records_lie_at_multiples_of_the_stride(spark, written):
    """Plain files: the place of a record is arithmetic."""
    layout = t.read_layout(spark, f"{written}/out")
    folder = f"{written}/out/shards"
    names = [layout.name(k) for k in range(layout.shards)]
    assert sorted(n for n in os.listdir(folder) if not n.startswith(".")) == names and layout.shards > 4
    assert [os.path.getsize(f"{folder}/{n}") for n in names] == [layout.records(k) * layout.stride for k in range(layout.shards)]
    assert sum(layout.records(k) for k in range(layout.shards)) == layout.sequences
    for r in read_positions(spark, f"{written}/out").collect():
        with open(f"{folder}/{layout.name(r.position // 30)}", "rb") as file:
            file.seek(r.position % 30 * layout.stride)
            data = file.read(layout.stride)
        assert r.shard == r.position // 30
        assert data == int(r.n_tokens).to_bytes(4, "little") + bytes(r.ids)


def test_positions_resume(spark, written):
    whole = sorted(read_positions(spark, f"{written}/out").collect(), key=lambda r: r.position)
    part = sorted(read_positions(spark, f"{written}/out", 37, 95).collect(), key=lambda r: r.position)
    assert part == whole[37:95]
    assert read_positions(spark, f"{written}/out", len(whole) - 1).collect() == whole[-1:]
    assert read_positions(spark, f"{written}/out", len(whole)).collect() == []
    assert sorted(read_positions(spark, f"{written}/out", -5, 10**9).collect()) == whole


def test_same_key_same_order(spark, written):
    docs = spark.read.parquet(f"{written}/docs")
    write_training_order(docs, f"{written}/again", key=7, length=64, shard_sequences=30)
    write_training_order(docs, f"{written}/other", key=8, length=64, shard_sequences=30)
    first, again, other = (
        [bytes(r.ids) for r in read_positions(spark, f"{written}/{n}").orderBy("position").collect()] for n in ("out", "again", "other")
    )
    assert first == again != other and sorted(first) == sorted(other)
    with pytest.raises(FileExistsError):
        write_training_order(docs, f"{written}/out", key=7, length=64, shard_sequences=30)


def test_a_stopped_write_goes_on(spark, written, tmp_path, monkeypatch):
    """Shards that are there stay untouched; missing, short and draft ones are written."""
    docs, path = spark.read.parquet(f"{written}/docs"), str(tmp_path / "out")
    options = {"key": 7, "length": 64, "shard_sequences": 30}

    def stopped(*args, **options):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        plain = t.staged
        m.setattr(t, "staged", lambda spark, folder, about: plain(spark, folder, about) if folder.endswith("sequences") else stopped())
        with pytest.raises(RuntimeError, match="stopped"):
            write_training_order(docs, path, **options)
    with pytest.raises(NotCommitted):
        read_positions(spark, path)
    with pytest.raises(FileExistsError, match="other settings"):
        write_training_order(docs, path, **(options | {"key": 8}))
    os.remove(f"{path}/shards/shard-00000001.tokens")
    with open(f"{path}/shards/shard-00000002.tokens", "r+b") as file:
        file.truncate(100)
    before = os.stat(f"{path}/shards/shard-00000000.tokens").st_mtime_ns
    write_training_order(docs.limit(0), path, **options)  # the sequences were cut already
    assert os.stat(f"{path}/shards/shard-00000000.tokens").st_mtime_ns == before
    got, want = (sorted(read_positions(spark, p).collect()) for p in (path, f"{written}/out"))
    assert got == want


def test_empty_table(spark, documents, tmp_path):
    assert write_training_order(documents([]), f"{tmp_path}/none").sequences == 0
    assert read_positions(spark, f"{tmp_path}/none").collect() == []
