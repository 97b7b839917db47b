"""Chat formatting: conversations through a compiled template, and reading the output back.

The template marks turns with control strings; the ``guard`` filter puts a backslash before every
backslash and control string inside texts, so that text can't end or begin a turn and nothing is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.templates import Template

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>"
TEMPLATE = (
    "{% for m in messages %}" + OPEN + "{{ m.role | guard }}" + AFTER_ROLE + "{% if m.role == 'assistant' %}"
    "{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}" + CLOSE + "\n{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, ("\\", OPEN, AFTER_ROLE, CLOSE))))
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Characters of one output batch.
BATCH_CHARS = 8 << 20


def guard(text: object) -> str:
    """Reversibly escapes control strings: the result has none of them without a backslash in front."""
    return _CONTROL.sub(lambda m: "\\" + m[0], "" if text is None else str(text))


def unguard(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def compiled(source: str = TEMPLATE) -> Template:
    return Template(source, {"guard": guard})


def _end(text: str, mark: str, at: int) -> int:
    """Where the next ``mark`` begins that an odd run of backslashes doesn't escape."""
    while True:
        k = text.index(mark, at)
        slashes = k
        while slashes > at and text[slashes - 1] == "\\":
            slashes -= 1
        if (k - slashes) % 2 == 0:
            return k
        at = k + 1


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in the output of TEMPLATE."""
    at = 0
    while at < len(formatted):
        role_end = _end(formatted, AFTER_ROLE, at + len(OPEN))
        text_end = _end(formatted, CLOSE, role_end + len(AFTER_ROLE))
        yield unguard(formatted[at + len(OPEN) : role_end]), unguard(formatted[role_end + len(AFTER_ROLE) : text_end])
        at = text_end + len(CLOSE) + 1


def format_conversations(turns: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<begin, end>>) of turns (conv_id, turn, role, text).

    Turns are in order of turn, equal turns of role and text; null turns come first, a null text or role
    counts as empty, rows of a null conv_id are one conversation, repeated rows stay. Spans are code point
    offsets. A conversation is one output row, made while streaming over sorted rows: a task holds one at
    a time, not its partition. Other columns are not read; an empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, held, size = compiled(source), [], 0
        shape = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

        def flush() -> pa.RecordBatch:
            ids, texts, spans = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array(spans, shape)], ["conv_id", "formatted", "loss_spans"])

        id_type = None
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field(0).type
        for conv, group in groupby(rows(_chain(first, batches)), key=lambda r: r[0]):
            messages = ({"role": r[2], "text": r[3]} for r in group)
            text, spans = template.render(messages=messages)
            held.append((conv, text, [{"begin": a, "end": b} for a, b in spans]))
            size += len(text)
            if size >= BATCH_CHARS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    tidy = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<begin:int,end:int>>")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from (conv_id, formatted, loss_spans): turn and loss digests by conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read_back(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = unguard(text[s["begin"] : s["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                out.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
