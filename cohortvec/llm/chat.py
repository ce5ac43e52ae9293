"""Chat formatting: typed content parts to one marked text per conversation.

A turn's content is a text or a list of typed parts.  A visitor flattens text,
image, audio and document parts in order: media become numbered placeholders,
with a record of the attachment and of the tokens the placeholder expands to.
Control strings inside texts are broken by a backslash that reading back takes
out again, so no text can open or close a turn.

Turns of a conversation follow each other in one task, sorted; only the running
numbers of the current conversation are kept, so a conversation may be of any
length.  Output has one row per turn; a conversation's formatted text is its
rows in order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import bound_batches

# Fixed values of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
LEARNED_ROLES = ("assistant",)

# Strings that some chat template reads as control, and the escape itself.
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.DOTALL)

# Tokens a placeholder stands for.
IMAGE_PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 1024

PARTS = "array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"

SCHEMA = (
    "conv_id bigint, position bigint, turn bigint, role string, formatted string, start bigint, "
    "loss_start bigint, loss_end bigint, placeholder_tokens bigint, "
    "attachments array<struct<kind:string,number:bigint,ref:string,at:bigint,tokens:bigint>>"
)


def escape(text: str) -> str:
    """``text`` without any control string; ``unescape`` gives it back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one turn; counters run on through a conversation."""

    def __init__(self) -> None:
        self.numbers = {"image": 0, "audio": 0, "document": 0}

    def visit(self, parts: list[dict]) -> tuple[str, list[dict]]:
        """Text with placeholders, and one record per attachment (``at`` counts from its begin)."""
        out, records, length = [], [], 0
        for part in parts:
            kind = part.get("type") or "text"
            flat = getattr(self, f"visit_{kind}", self.visit_text)(part)
            if kind in self.numbers:
                self.numbers[kind] += 1
                tokens, flat = flat, f"<|{kind}_{self.numbers[kind]}|>"
                records.append(
                    {"kind": kind, "number": self.numbers[kind], "ref": part.get("ref"), "at": length, "tokens": tokens}
                )
            out.append(flat)
            length += len(flat)
        return "".join(out), records

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> int:
        sides = ((part.get(side) or IMAGE_PATCH) for side in ("width", "height"))
        return math.prod(math.ceil(side / IMAGE_PATCH) for side in sides)

    def visit_audio(self, part: dict) -> int:
        return math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND)

    def visit_document(self, part: dict) -> int:
        return (part.get("pages") or 1) * DOCUMENT_TOKENS_PER_PAGE


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    learned_roles: tuple[str, ...] = LEARNED_ROLES,
) -> DataFrame:
    """One row per turn, in order of ``position`` within its conversation.

    ``formatted`` is the marked turn, ``start`` its place in the conversation's
    text, ``loss_start`` and ``loss_end`` the part that is learned, empty for
    other roles (all in code points).  ``parts_col`` names an array of typed
    parts (fields of ``PARTS``; unknown types count as text) and replaces
    ``text_col``.  Turns come by turn, then role and text, so ties and repeated
    rows have a fixed place; null turns come first.  Null role, text or parts are
    empty; rows without a conversation id form one conversation.  Other columns
    are not looked at.
    """
    content = (
        F.expr(f"cast(null as {PARTS})") if parts_col is None else F.col(parts_col).cast(PARTS)
    ).alias("parts")
    text = (F.lit(None).cast("string") if parts_col is not None else F.col(text_col)).alias("text")
    bound_batches(turns.sparkSession)
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).alias("role"),
        text,
        content,
    )
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text", F.to_json("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, place, visitor = object(), 0, 0, PartVisitor()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    current, position, place, visitor = row["conv_id"], 0, 0, PartVisitor()
                body, records = visitor.visit(row["parts"] or [{"type": "text", "text": row["text"]}])
                role = row["role"] or ""
                head = f"{TURN}{escape(role)}{SAYS}"
                begin = place + len(head)
                for record in records:
                    record["at"] += begin
                formatted = f"{head}{body}{END}"
                out.append(
                    {
                        "conv_id": current,
                        "position": position,
                        "turn": row["turn"],
                        "role": role,
                        "formatted": formatted,
                        "start": place,
                        "loss_start": begin,
                        "loss_end": begin + (len(body) if role in learned_roles else 0),
                        "placeholder_tokens": sum(r["tokens"] for r in records),
                        "attachments": records,
                    }
                )
                position += 1
                place += len(formatted)
            yield pa.RecordBatch.from_pylist(out, _arrow_schema())

    return sorted_rows.mapInArrow(run, SCHEMA)


def _arrow_schema() -> pa.Schema:
    record = pa.struct(
        [("kind", pa.string()), ("number", pa.int64()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]
    )
    return pa.schema(
        [
            ("conv_id", pa.int64()),
            ("position", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("formatted", pa.string()),
            *((c, pa.int64()) for c in ("start", "loss_start", "loss_end", "placeholder_tokens")),
            ("attachments", pa.list_(record)),
        ]
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of every conversation, from the rows of ``format_conversations`` as they come.

    Roles and texts are parsed out of the formatted text, learned text is cut
    out by the loss marks; both are unescaped.  ``turns_sha256`` covers role,
    line feed, text, line feed of each turn, ``loss_sha256`` the learned text.
    Needs the order that ``format_conversations`` has within a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, digest = object(), None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["conv_id"] != conversation:
                    if digest:
                        done.append(digest.row(conversation))
                    conversation, digest = row["conv_id"], _Digest()
                digest.add(row)
            yield _digests(done)
        if digest:
            yield _digests([digest.row(conversation)])

    return formatted.select("conv_id", "formatted", "start", "loss_start", "loss_end").mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


class _Digest:
    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        marked = row["formatted"]
        for role, text in _SEGMENT.findall(marked):
            self.turns += 1
            self.turns_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        learned = unescape(marked[row["loss_start"] - row["start"] : row["loss_end"] - row["start"]])
        self.loss_chars += len(learned)
        self.loss_hash.update(learned.encode())
        self.chars += len(marked)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
