"""Conversations as texts with a loss mask, and back.

A text that contains control strings must not forge turns: at each place where
one starts, a backslash goes after its first character, and backslashes are
doubled before; ``unescape`` undoes both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.scratch import Scratch
from galena.llm.templates import Template

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Never left whole in a text: ours and those of common chat formats.
CONTROL = (TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{% for m in messages %}{{ '" + TURN + "' }}{{ m.role|escape }}{{ '" + SAYS + "' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '" + END + "' + '\\n' }}{% endfor %}"
)
_STARTS = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)", re.S)
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}\n", re.S)


def escape(text: str | None) -> str:
    return _STARTS.sub(r"\1\\", (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss (array of start and end): one row per conv_id of ``rows`` (conv_id, turn, role, text).

    Turns come in order of turn, null first, and equal turns in that of role and
    text; repeated rows are turns of their own.  A null role or text is empty, and a
    null conv_id is a conversation like others.  A conversation is one text, so its
    turns meet in one task; other conversations don't.
    """
    shown = rows.select("conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"))
    grouped = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Template(template, {"escape": escape}).render
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                done = [render(messages=m) for m in some.column(1).to_pylist()]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], kind)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([t for t, _ in done], pa.string()), spans], names=["conv_id", "formatted", "loss"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that the template above made."""
    found, at = [], 0
    for m in _TURNS.finditer(formatted):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return found


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the formatted texts and their masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                row = len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formats ``rows``, writes the texts and reads them back."""
    return read_conversations(Scratch(rows.sparkSession, "chat").keep("formatted", format_conversations(rows, template)))
