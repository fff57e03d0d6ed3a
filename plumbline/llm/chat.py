"""Chat formatting: a state machine over roles checks the order of turns, a declarative template emits text segments,
each with a flag that says whether it counts for the loss.

Turns are sorted within partitions by conversation and turn and then streamed, so a task holds one Arrow batch and one
state, however long a conversation is; no conversation is collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, batch


@dataclass(frozen=True)
class Template:
    """Role and text stand between the three control strings of ``turn``. Each of these holds a bar; a bar of a role or text
    is written as backslash and p, a backslash twice, so the first bar after a role or text is its control string's."""

    turn: tuple[str, str, str] = ("<|", "|>\n", "<|end|>\n")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        if not all("|" in control for control in self.turn):
            raise ValueError("each control string needs a bar")

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state and whether the move is allowed; after a wrong turn the machine goes on from its role."""
        to = self.moves.get(state, {}).get(role)
        return (to, True) if to else (role if role in self.moves else "unknown", False)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        opened, closed, end = self.turn
        return [(opened + escape(role) + closed, False), (escape(text), role in self.loss_roles), (end, False)]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\p") if "\\" in text or "|" in text else text


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "|" if m[1] == "p" else m[1], text) if "\\" in text else text


def read_turns(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """(role, text) of each turn, from formatted text alone."""
    opened, closed, end = template.turn
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(closed, at + len(opened))
        stop = formatted.index(end, head + len(closed))
        out.append((unescape(formatted[at + len(opened) : head]), unescape(formatted[head + len(closed) : stop])))
        at = stop + len(end)
    return out


_TURNS = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("state", pa.string()), ("allowed", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))]
)


def _formatter(template: Template) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        current, state, position = object(), template.start, 0
        for rows in batches:
            out: list[list] = [[] for _ in _TURNS]
            for conv, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, state, position = conv, template.start, 0
                state, allowed = template.step(state, role)
                parts = [{"text": t, "loss": x} for t, x in template.segments(role, text)]
                for column, value in zip(out, (conv, position, state, allowed, parts)):
                    column.append(value)
                position += 1
            yield batch(_TURNS, out)

    return run


def format_chat(df: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each turn, in order within partitions: conv_id, position, state, allowed, segments(text, loss).

    Null roles and texts are empty; an unknown role is formatted and not allowed; a null conv_id is a conversation of its
    own; turns of equal number are ordered by role and text, null turns come first; repeated rows are turns of their own;
    nothing is dropped; a text of any length is one segment; an empty table gives no turns; other columns are not read.
    """
    slim = df.select(
        df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"),
        F.coalesce(df["role"], F.lit("")).alias("role"), F.coalesce(df["text"], F.lit("")).alias("text"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatter(template), "conv_id long, position long, state string, allowed boolean, segments array<struct<text string, loss boolean>>")


_DIGEST = [("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("n_bad_turns", "long"), ("complete", "boolean")]
_DIGEST_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in _DIGEST])


class _Reading:
    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars, self.formatted, self.bad, self.state = conv, 0, 0, 0, 0, 0, None
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def turn(self, state: str, allowed: bool, parts: list[dict], template: Template) -> None:
        formatted = "".join(p["text"] for p in parts)
        for role, text in read_turns(formatted, template):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for p in parts:
            if p["loss"]:
                text = unescape(p["text"])
                self.loss += len(text)
                self.masked.update(text.encode())
        self.formatted += len(formatted)
        self.bad += not allowed
        self.state = state

    def row(self, template: Template) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.formatted, self.bad, not self.bad and self.state in template.final


def _reader(template: Template) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for rows in batches:
            done = []
            for conv, state, allowed, parts in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "state", "allowed", "segments"))):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.row(template))
                    now = _Reading(conv)
                now.turn(state, allowed, parts, template)
            if done:
                yield batch(_DIGEST_ARROW, [list(c) for c in zip(*done)])
        if now:
            yield batch(_DIGEST_ARROW, [[v] for v in now.row(template)])

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests by conversation, read from the formatted segments alone, in the partitions that format_chat made."""
    return formatted.mapInArrow(_reader(template), ", ".join(f"{n} {t}" for n, t in _DIGEST))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev FROM c),
b AS (SELECT *, CASE WHEN prev IS NULL AND role IN ('system', 'user') OR prev = 'system' AND role = 'user' OR prev = 'user' AND role = 'assistant' OR prev = 'assistant' AND role = 'user' THEN 0 ELSE 1 END AS bad FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(13 + length(replace(replace(role, '\', '\\'), '|', '\p')) + length(replace(replace(text, '\', '\\'), '|', '\p'))) AS BIGINT) AS formatted_chars,
       CAST(sum(bad) AS BIGINT) AS n_bad_turns,
       sum(bad) = 0 AND arg_max(role, turn) = 'assistant' AS complete
FROM b GROUP BY conv_id
"""
