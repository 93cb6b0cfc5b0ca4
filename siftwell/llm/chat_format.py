"""Chat formatting with a grammar round trip.

A conversation is rendered with a template of control strings. A deterministic parser reads the rendered text back;
where the turns it recovers differ from the source, the conflicting content is escaped and the text is rendered and
parsed again until both are identical. The template's segments delimit themselves (a segment begins with the start
mark and ends after the end mark, neither of which can stand unescaped inside a text), so the parse of a conversation
is the concatenation of the parses of its segments, and a conversation of any length is streamed turn by turn.

Spark shuffles turns by conversation and sorts them inside the partitions; tasks read the sorted rows in Arrow
batches and keep the state of one conversation only, so memory doesn't grow with a conversation.

Defined results: a null text or role counts as empty; turns of one number are ordered by role and text; null turns
come first; a null ``conv_id`` is one conversation of its own; empty tables give empty results; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that must never stand raw inside a text: the template's own, and those of other common templates.
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ANY = "|".join(map(re.escape, CONTROL))
_ESCAPE = re.compile(rf"(\\*)({_ANY})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_ANY}))")
_RAW = re.compile(rf"(?<!\\)(?:{_ANY})")
_ROLE = re.compile(r"[^A-Za-z0-9_-]")
_ROLE_CODE = re.compile(r"%([0-9a-f]+);")
#: Written before the text of a segment whose every character is coded: the last resort of :func:`render_turn`.
CODED = "\\u:"


def escape(text: str) -> str:
    """A backslash more before each control string and the backslashes that precede it."""
    return _ESCAPE.sub(lambda m: "\\" + m[1] + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _coded(text: str) -> str:
    return CODED + "".join(f"{ord(c):x}." for c in text)


def _decode(content: str) -> str:
    if content.startswith(CODED):
        return "".join(chr(int(x, 16)) for x in content[len(CODED) :].split(".")[:-1])
    return unescape(content)


def _segment(role: str, content: str) -> str:
    return f"{START}{_ROLE.sub(lambda m: f'%{ord(m[0]):x};', role)}\n{content}\n{END}\n"


def parse_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """``(role, text, first, last)`` of each segment: the content is ``formatted[first:last]`` before decoding.

    Raises ValueError where the text isn't of the grammar ``(START role NL content NL END NL)*``.
    """
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no start mark at {at}")
        line = formatted.find("\n", at)
        if line < 0:
            raise ValueError("a role has no end")
        role = _ROLE_CODE.sub(lambda m: chr(int(m[1], 16)), formatted[at + len(START) : line])
        mark = _RAW.search(formatted, line + 1)
        if mark is None or mark[0] != END or mark.start() == line + 1 or formatted[mark.start() - 1] != "\n" or not formatted.startswith("\n", mark.end()):
            raise ValueError(f"the segment at {at} doesn't end with its end mark")
        yield role, _decode(formatted[line + 1 : mark.start() - 1]), line + 1, mark.start() - 1
        at = mark.end() + 1


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse_turns(rendered)] == [(role, text)]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> str:
    """The first of the plain, the escaped and the coded rendering that reads back as the source."""
    for make in (str, escape, _coded):
        if _reads_back(rendered := _segment(role, make(text)), role, text):
            return rendered
    raise ValueError("a turn can't be rendered")


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return slim.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """Rows as an Arrow batch: integers beside a null stay integers, which pandas would turn into doubles."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The rendered corpus, one row per turn in order: ``conv_id, segment, start, length, rendered, loss_start, loss_length``.

    ``start`` and ``loss_start`` are places (code points) in the conversation's formatted text, which is the
    concatenation of ``rendered`` by ``segment``; the loss span (null for other roles) covers the content of a turn.
    """

    fields = [("conv_id", pa.int64()), ("segment", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, at = object(), 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, segment, at = conv, 0, 0
                rendered = render_turn(role, text)
                _, _, first, last = next(parse_turns(rendered))
                mine = role == loss_role
                rows.append((conv, segment, at, len(rendered), rendered, at + first if mine else None, last - first if mine else None))
                segment, at = segment + 1, at + len(rendered)
            yield _batch(rows, fields)

    schema = "conv_id long, segment long, start long, length long, rendered string, loss_start long, loss_length long"
    return _sorted_turns(conversations).mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of what the parser recovers from :func:`format_turns`, one row per conversation.

    ``formatted`` must come straight from that operator (same partitions and order), so nothing is shuffled again.
    """

    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def done() -> tuple:
            return (state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "start", "rendered", "loss_start", "loss_length"))
            for conv, segment, start, rendered, loss_start, loss_length in zip(*columns, strict=True):
                if segment == 0:
                    if state:
                        rows.append(done())
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text, _, _ in parse_turns(rendered):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                if loss_start is not None:
                    first = loss_start - start
                    text = _decode(rendered[first : first + loss_length])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
                state["chars"] += len(rendered)
            yield _batch(rows, fields)
        if state:
            yield _batch([done()], fields)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
