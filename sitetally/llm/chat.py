"""Chat formatting with typed content parts.

A turn's content is a list of parts (type, text, ref, units). A visitor flattens it: text is escaped, an image, audio or
document part becomes an ordered placeholder whose reference and expanded number of tokens are recorded. Turns are written as

    <|im_start|>role\\ncontent<|im_end|>\\n

and a loss mask holds the spans of assistant texts, in code points. Inside texts and roles every `<`, run of backslashes and `|`
gets one more backslash, so no control string can arise there, and taking it away again restores the text. In roles, backslashes
and line breaks are escaped too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
#: Tokens that a placeholder stands for: per tile of an image, second of audio, page of a document; and at least.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type string, text string, ref string, units bigint>"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_HEAD = re.compile(r"<\|im_start\|>([^\n]*)\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one conversation; placeholders are counted through all of its turns."""

    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['type']}")(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def _placeholder(self, part: dict) -> str:
        number, kind = len(self.attachments) + 1, part["type"]
        self.attachments.append((number, kind, part.get("ref"), UNIT_TOKENS[kind] * max(1, part.get("units") or 1)))
        return f"<|{kind}_{number}|>"

    visit_image = visit_audio = visit_document = _placeholder


def _joined(parts: list[dict]) -> Iterator[dict]:
    """Parts with neighbouring texts made one (an unknown kind of part counts by its text), so that no control string arises where two texts meet."""
    texts: list[str] = []
    for part in [*parts, None]:
        if part is not None and part.get("type") not in UNIT_TOKENS:
            texts.append(part.get("text") or "")
            continue
        if texts:
            yield {"type": "text", "text": "".join(texts)}
            texts = []
        if part is not None:
            yield part


def format_turns(turns: list[dict]) -> tuple[str, list[tuple[int, int]], list[tuple[int, str, str | None, int]]]:
    """Text, loss spans (code points, begin and end) and attachments of one conversation's turns (role, parts)."""
    out, spans, at, visitor = [], [], 0, Flattener()

    def put(text: str) -> None:
        nonlocal at
        out.append(text)
        at += len(text)

    for turn in turns:
        role = turn["role"] or ""
        put(f"{START}{escape_role(role)}\n")
        for part in _joined(turn["parts"] or []):
            begin, attached = at, len(visitor.attachments)
            put(visitor.visit(part))
            if role == LOSS_ROLE and at > begin and len(visitor.attachments) == attached:
                spans.append((begin, at))
        put(END)
    return "".join(out), spans, visitor.attachments


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted conversation; placeholders stay in the content."""
    turns, at = [], 0
    while head := _HEAD.match(formatted, at):
        end = formatted.index(END, head.end())
        turns.append((unescape_role(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END)
    if at != len(formatted):
        raise ValueError("what follows the last turn is no turn")
    return turns


def text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `parts`: its text as the one part of each row; null is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return df.withColumn("parts", F.array(part))


_OUT = "conv_id long, n_turns long, formatted string, loss_spans array<struct<begin bigint, end bigint>>, attachments array<struct<number bigint, type string, ref string, tokens bigint>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(1).to_pylist()
        found = [format_turns(turns) for turns in held]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in held], pa.int64()), pa.array([f for f, _, _ in found], pa.string()),
             pa.array([[{"begin": a, "end": b} for a, b in s] for _, s, _ in found], _SPANS),
             pa.array([[dict(zip(("number", "type", "ref", "tokens"), a, strict=True)) for a in at] for _, _, at in found], _ATTACHED)],
            names=["conv_id", "n_turns", "formatted", "loss_spans", "attachments"],
        )


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, parts) to one row per conversation: formatted text, loss spans, attachments.

    Turns go by number, null first, rows of one number by role and parts, so repeated rows are turns of their own. Null roles
    and texts are empty. Null conv_ids form one conversation. An empty table gives no rows. Other columns are not read.
    A conversation is one output row, so its turns have to meet in a task; other conversations don't.
    """
    prepare(rows.sparkSession)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.mapInArrow(_formatted, _OUT)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse_turns(formatted)
            learned = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
            values = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(formatted))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                         names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted text."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, schema)
