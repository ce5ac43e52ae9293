import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortvec.llm import chat
from cohortvec.llm.chat import escape, format_conversations, read_back, unescape

MARKS = ["<|turn|>", "<|says|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>"]
PIECES = st.lists(st.sampled_from([*MARKS, "\\", "<", "|", "/", "s>", "[", "a", "\n", "É"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escaping_is_reversible_and_complete(text):
    assert unescape(escape(text)) == text
    assert not any(mark.strip() in escape(text) for mark in MARKS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [
    (1, 1, "assistant", "fine\\n"), (1, 0, "user", "how <|end|>\n are [INST] you"), (1, 2, "assistant", None),
    (2, 0, None, "no role"), (2, None, "user", "no turn"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"),
    (3, 0, "assistant", "a"), (None, 0, "user", "no id"), (4, 0, "assistant", "w " * 50_000), (5, 0, "odd\nrole<|says|>", ""),
]


def test_read_back_edge_cases(spark):
    turns = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "conv_id int, turn int, role string, text string, start int, formatted string")
    got = {r.conv_id: r for r in read_back(format_conversations(turns)).collect()}
    assert len(got) == 6
    for conv, r in got.items():
        own = sorted(
            ((t, role, text) for c, t, role, text in ROWS if c == conv),
            key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""),
        )
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own))
        learned = "".join(text or "" for _, role, text in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_offsets(spark):
    turns = spark.createDataFrame(ROWS[:3], "conv_id int, turn int, role string, text string")
    rows = sorted(format_conversations(turns).collect(), key=lambda r: r.position)
    whole = "".join(r.formatted for r in rows)
    for r in rows:
        assert whole[r.start :].startswith(r.formatted)
    assert [unescape(whole[r.loss_start : r.loss_end]) for r in rows] == ["", "fine\\n", ""]


def test_typed_parts(spark):
    part = {"type": "text", "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    content = [
        part | {"text": "see "},
        part | {"type": "image", "ref": "cat.png", "width": 57, "height": 28},
        part | {"type": "audio", "ref": "a.wav", "seconds": 1.5},
        part | {"type": "document", "ref": "d.pdf", "pages": 3},
        part | {"type": "other", "text": " <s>"},
    ]
    second = [part | {"type": "image", "ref": "dog.png"}]
    turns = spark.createDataFrame(
        [(1, 0, "user", content), (1, 1, "user", second), (1, 2, "user", None)],
        f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}",
    )
    rows = sorted(format_conversations(turns, parts_col="parts").collect(), key=lambda r: r.position)
    assert rows[0].formatted == "<|turn|>user<|says|>see <|image_1|><|audio_1|><|document_1|> <\\s><|end|>\n"
    assert "<|image_2|>" in rows[1].formatted
    assert [a.tokens for a in rows[0].attachments] == [3, 38, 3 * 1024]
    assert [a.ref for a in rows[0].attachments] == ["cat.png", "a.wav", "d.pdf"]
    whole = "".join(r.formatted for r in rows)
    for r in rows:
        for a in r.attachments:
            assert whole[a.at :].startswith(f"<|{a.kind}_{a.number}|>")
        assert r.placeholder_tokens == sum(a.tokens for a in r.attachments)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert read_back(format_conversations(turns)).collect() == []


@pytest.mark.parametrize("size", [40])
def test_conversations_over_several_batches(spark, size):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in range(5) for t in range(size)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = read_back(format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 5
    for r in got:
        assert r.loss_sha256 == sha("".join(f"{r.conv_id}-{t}" for t in range(1, size, 2)))
