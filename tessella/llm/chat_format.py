"""Chat formatting with spans found by incremental rendering of a black box.

A template is any function from a list of (role, text) turns to one string.  The
prefixes of a conversation are rendered one turn further at a time; where the
longer output starts with the shorter one, what follows is the new turn's span.
Where it does not, the template rewrites history, which is reported.  A render
with a placeholder for the text tells the turn's frame from its content, so the
loss mask covers the content of the trained role only.

Every prefix is rendered, none is cut, so a template is caught wherever it rewrites.
A black box must be asked anew for each prefix: a conversation costs the square of
its length.

Scale.  Turns are shuffled by conversation and sorted, then streamed: a task
holds one conversation at a time and nothing else.

Defined results.  Null texts and roles are empty.  Turns are ordered by turn
(null first), role and text, so ties and repeated rows keep a fixed order.  A
null conv_id is a conversation of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import query, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
PLACEHOLDER = "\ue000"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before control strings and backslashes."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of this library: ``### role: text</turn>``, escaped."""
    return "".join(f"### {escape(r).replace(':', chr(92) + ':')}: {escape(t)}</turn>\n" for r, t in turns)


def read_turn(span: str) -> Turn:
    """Role and text of one turn as ``marked_turns`` wrote it."""
    m = _TURN.fullmatch(span)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m.group(1)), unescape(m.group(2))


def locate(render: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int | None]:
    """(output, span of each turn, first turn that rewrites history or None).

    Spans end before the first turn that rewrites.
    """
    spans, done = [], render([])
    for i in range(len(turns)):
        more = render(turns[: i + 1])
        if not more.startswith(done):
            return render(turns), spans, i
        spans.append((len(done), len(more)))
        done = more
    return done, spans, None


def content(render: Template, span: str, role: str) -> tuple[int, int]:
    """Where the text stands inside the span of a turn, by a placeholder."""
    alone = render([(role, PLACEHOLDER)])
    frame = alone[len(render([])) :]
    head = frame.find(PLACEHOLDER)
    tail = len(frame) - head - len(PLACEHOLDER)
    if head < 0 or span[:head] != frame[:head] or span[len(span) - tail :] != frame[len(frame) - tail :]:
        raise ValueError("the frame of a turn depends on its place")
    return head, len(span) - tail


def format_conversation(turns: list[Turn], render: Template = marked_turns, trained: str = "assistant") -> dict:
    """Output, spans and loss mask of one conversation."""
    output, spans, rewritten = locate(render, turns)
    mask = []
    if rewritten is None:
        for (role, _), (a, z) in zip(turns, spans):
            if role == trained:
                lo, hi = content(render, output[a:z], role)
                mask.append((a + lo, a + hi))
    return {"output": output, "spans": spans, "mask": mask, "rewritten": rewritten}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    key, turns, any_row = None, [], False
    for b in batches:
        for k, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if any_row and k != key:
                yield key, turns
                turns = []
            key, any_row = k, True
            turns.append((role or "", text or ""))
    if any_row:
        yield key, turns


def _formatted(render: Template, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, rows = pa.int64(), []

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        def flush() -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            schema = pa.schema([("conv_id", id_type), ("output", pa.string()), ("spans", span), ("mask", span), ("rewritten", pa.int32())])
            return pa.RecordBatch.from_pylist(rows, schema)

        size = 0
        for key, turns in _conversations(watched()):
            got = format_conversation(turns, render, trained)
            for c in ("spans", "mask"):
                got[c] = [{"start": a, "end": z} for a, z in got[c]]
            rows.append({"conv_id": key, **got})
            size += len(got["output"])
            if size >= 1 << 22:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return run


def format_chats(conversations: DataFrame, render: Template = marked_turns, trained: str = "assistant", conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, output, spans, mask (code points) and rewritten per conversation."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    t = rows.schema["conv_id"].dataType.simpleString()
    span = "array<struct<start:bigint,end:bigint>>"
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_formatted(render, trained), f"conv_id {t}, output string, spans {span}, mask {span}, rewritten int")
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.select(["output", "spans", "mask"]).to_pylist():
            turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for s in r["spans"]:
                role, text = read_turn(r["output"][s["start"] : s["end"]])
                turns.update(f"{role}\n{text}\n".encode())
            for s in r["mask"]:
                text = unescape(r["output"][s["start"] : s["end"]])
                loss.update(text.encode())
                chars += len(text)
            rows.append((len(r["spans"]), turns.hexdigest(), chars, loss.hexdigest(), len(r["output"])))
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the output of ``marked_turns`` says, read through spans and mask."""
    t = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _read_back,
        f"conv_id {t}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


#: A conversation whose texts hold the template's own control strings.
HOSTILE = r"\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '\\|###|</turn>|:', 'x\0', 'g'))
              + length(regexp_replace(text, '\\|###|</turn>', 'x\0', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op4_chat_format", SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what their outputs say."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(rows.unionByName(hostile)))
