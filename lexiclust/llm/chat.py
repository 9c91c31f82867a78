"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them in order: text is written with its control strings escaped, every
other part becomes one placeholder and leaves an attachment reference and the
number of tokens that the placeholder expands to. The template marks turns with
control strings of its own; the escape is reversible, so ``read_back`` gets
every turn from the formatted text and the loss mask alone.

One turn is one row with its segment of the formatted conversation; a
conversation is its segments in order. No conversation is gathered into one
value, so its length is not bounded by a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Template and control strings (fixed values of this format).
TURN, BODY, END = "<|turn|>", "<|body|>", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TOKENS_A_UNIT = {"image": 256, "audio": 25, "document": 512}  # a tile, a second, a page
_CONTROL = r"(/?s>|/?INST\]|\|[a-z_]+\|>)"  # after "<" or "["
ESCAPE = r"([<\[])(\\*)" + _CONTROL
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)

PART = "struct<type:string,text:string,ref:string,units:bigint>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """One backslash more inside every control string: none is left bare."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def text_part(text: Column) -> Column:
    """The content of a turn that is one text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"),
                            none.cast("string").alias("ref"), none.cast("bigint").alias("units")))


def visit(part: Column) -> Column:
    """``piece``, ``ref``, ``type`` and ``tokens`` of one part. A part of
    another type, or of none, is written like text."""
    kind = part["type"]
    piece, tokens = F.coalesce(escaped(part["text"]), F.lit("")), F.lit(0).cast("bigint")
    for name, mark in PLACEHOLDERS.items():
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))
        piece = F.when(kind == name, F.lit(mark)).otherwise(piece)
        tokens = F.when(kind == name, units * TOKENS_A_UNIT[name]).otherwise(tokens)
    return F.struct(piece.alias("piece"), part["ref"].alias("ref"), kind.alias("type"),
                    tokens.alias("tokens"))


def format_turns(turns: DataFrame, content: Column | None = None, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text",
                 loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``segment`` (its part of the
    formatted conversation), ``loss_start`` and ``loss_end`` (code points of the
    segment under the loss mask, empty unless the role is ``loss_role``),
    ``attachments`` (type, ref and tokens in order) and ``placeholder_tokens``.

    ``content`` is an array of parts (``PART``); by default the text column. A
    null text, role or content is empty. Repeated turns are kept, each as a row.
    Other columns are not read.
    """
    parts = F.transform(text_part(F.col(text)) if content is None
                        else F.coalesce(content, F.array().cast(f"array<{PART}>")), visit)
    name = escaped(F.coalesce(F.col(role), F.lit("")))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role) == loss_role, F.lit(False)).alias("_loss"),
                        F.concat(F.lit(TURN), name, F.lit(BODY)).alias("_head"), parts.alias("_p"))
    body = F.array_join(F.transform("_p", lambda x: x["piece"]), "")
    begin = F.length("_head").cast("long")
    attached = F.filter("_p", lambda x: x["type"].isin(*PLACEHOLDERS))
    return rows.withColumn("_body", body).select(
        "conv_id", "turn", F.concat("_head", "_body", F.lit(END)).alias("segment"),
        begin.alias("loss_start"),
        (begin + F.when(F.col("_loss"), F.length("_body")).otherwise(0)).alias("loss_end"),
        F.transform(attached, lambda x: F.struct(x["type"], x["ref"], x["tokens"]))
        .alias("attachments"),
        F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"])
        .alias("placeholder_tokens"))


class _Reader:
    """Reads one conversation from its formatted text as it comes in."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, text: str, start: int, end: int) -> None:
        """More formatted text, and its range under the loss mask."""
        if end > start:
            masked = unescaped(text[start:end])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.chars += len(text)
        self.rest += text
        while (stop := self.rest.find(END)) >= 0:
            turn, self.rest = self.rest[:stop], self.rest[stop + len(END):]
            head, found, body = turn.partition(BODY)
            if not found or not head.startswith(TURN):
                raise ValueError("the formatted text is not of this template")
            self.turns += 1
            self.all.update(f"{unescaped(head[len(TURN):])}\n{unescaped(body)}\n".encode())

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("the formatted text ends inside a turn")
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text and the loss mask:
    ``conv_id``, ``n_turns``, ``turns_sha256`` (of role, line break, text, line
    break for each turn), ``loss_chars``, ``loss_sha256`` (of all masked text,
    unescaped) and ``formatted_chars``.

    Segments are sorted by conversation and turn inside each partition and read
    as a stream: one turn is held at a time. Turns that share a number follow in
    the order of their segments; a null turn comes first. Rows without a
    conversation id are one conversation with a null id.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint")
    ordered = (segments.select("conv_id", "turn", "segment", "loss_start", "loss_end")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names, types = None, None, None
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(),
                     pa.string(), pa.int64()]
            names = [x.strip().split(" ")[0] for x in schema.split(",")]
            done = []
            columns = (batch.column(c) for c in ("conv_id", "segment", "loss_start", "loss_end"))
            for conv_id, text, start, end in zip(*(c.to_pylist() for c in columns), strict=True):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv_id)
                reader.feed(text, start, end)
            if done:
                yield _batch(done, names, types)
        if reader is not None:
            yield _batch([reader.row()], names, types)

    return ordered.mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
