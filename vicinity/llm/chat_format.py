"""Chat formatting by incremental rendering of a black-box template.

A template is any function ``messages -> str`` (a list of ``(role, text)``).
Nothing about it is assumed: each conversation is rendered for its first turn,
its first two turns and so on, and each output is compared with the one before.
While the earlier output stays a prefix, the part that was added is the turn's
span.  A template that changes what it has already written (it strips old
reasoning, moves a system turn, closes the text only at the end ...) is caught
at the first turn where the prefix breaks: ``rewrites_at``.

Within a turn's span, the place of the text is found from outside as well: the
last turn is rendered with two one-character probes; what the two outputs share
before and after the probe is the turn's header and footer.  The loss mask is
the content part of every assistant span.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

# fixed values of the turn format
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_PROBES = ("\ue000", "\ue001")  # two texts of one character each, unlike in both ends


def escape(text: str) -> str:
    """Break every ``<|`` by one backslash more than it has; the result holds no ``<|``. :func:`unescape` undoes it."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one header line: line breaks and backslashes are written as ``\\n`` and ``\\\\``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_markers(messages: Messages) -> str:
    """The default template: a start mark with the role, the text, an end mark; control strings inside are escaped."""
    return "".join(f"{TURN_START}{escape_role(r)}\n{escape(t)}{TURN_END}" for r, t in messages)


def read_turn(span: str) -> tuple[str, str] | None:
    """``(role, text)`` read back from a span of :func:`turn_markers`, None if it is no such span."""
    if not (span.startswith(TURN_START) and span.endswith(TURN_END)):
        return None
    role, line, text = span[len(TURN_START):len(span) - len(TURN_END)].partition("\n")
    return (unescape_role(role), unescape(text)) if line else None


def _frame(one: str, two: str, skip: int) -> tuple[int, int]:
    """Length of what two outputs share before and after their probes, from ``skip`` on, which they share anyway."""
    left = skip + len(os.path.commonprefix((one[skip:], two[skip:])))
    return left, len(os.path.commonprefix((one[left:][::-1], two[left:][::-1])))


def render_incrementally(messages: Messages, template: Template) -> tuple[str, list[tuple | None], int | None]:
    """``(output, spans, rewrites_at)``.

    ``spans``: per turn ``(start, content_start, content_end, end)`` in code points of the output, None once the
    template has rewritten its history.  ``rewrites_at``: the first turn (from 0) whose output doesn't begin with
    the one before, None for an append-only template.
    """
    before, spans, broken = template([]), [], None
    for k, (role, text) in enumerate(messages):
        head = messages[:k]
        out = template([*head, (role, text)])
        one, two = (template([*head, (role, p)]) for p in _PROBES)
        if broken is None and not all(x.startswith(before) for x in (out, one, two)):
            broken = k
        if broken is None:
            left, right = _frame(one, two, len(before))
            spans.append((len(before), min(left, len(out)), max(len(out) - right, left), len(out)))
        else:
            spans.append(None)
        before = out
    return before, spans, broken


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations of rows that come sorted; only one is held at a time."""
    key, turns = None, []
    for b in batches:
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and conv != key:
                yield key, turns
                turns = []
            key = conv
            turns.append((role or "", text or ""))
    if turns:
        yield key, turns


FORMATTED = ("conv_id long, formatted string, rewrites_at long, "
             "turns array<struct<role:string, start:long, content_start:long, content_end:long, end:long, in_loss:boolean>>")


def format_conversations(turns: DataFrame, template: Template = turn_markers, loss_role: str = "assistant",
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, rewrites_at, turns`` (spans in code points, with the loss mask).

    Rows are spread by conversation and sorted by turn within tasks (ties: role, then text), then streamed, so a
    task holds one conversation at a time; hot ids are as long as their longest conversation and no longer.

    * null text or role: empty; null turn: before turn 0; null conv_id: one conversation of its own;
    * repeated rows are turns like any other; an empty table gives no rows; further columns are not read.

    After a rewrite the later turns have null spans and no loss: a span could no longer be told from outside.
    """
    def run(batches):
        rows = []
        for conv, messages in _conversations(batches):
            out, spans, broken = render_incrementally(messages, template)
            rows.append({"conv_id": conv, "formatted": out, "rewrites_at": broken, "turns": [
                {"role": role, "start": s and s[0], "content_start": s and s[1], "content_end": s and s[2],
                 "end": s and s[3], "in_loss": bool(s) and role == loss_role}
                for (role, _), s in zip(messages, spans)]})
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    i64 = pa.int64()
    turn = pa.struct([("role", pa.string()), ("start", i64), ("content_start", i64), ("content_end", i64), ("end", i64),
                      ("in_loss", pa.bool_())])
    schema = pa.schema([("conv_id", i64), ("formatted", pa.string()), ("rewrites_at", i64), ("turns", pa.list_(turn))])
    src = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return (src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, FORMATTED))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from the formatted texts alone, by their spans and loss mask.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_at``; for the output of
    :func:`turn_markers`.
    """
    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                all_turns, loss, n_loss = hashlib.sha256(), hashlib.sha256(), 0
                for t in r["turns"]:
                    role, text = read_turn(r["formatted"][t["start"]:t["end"]])
                    all_turns.update(f"{role}\n{text}\n".encode())
                    if t["in_loss"]:
                        masked = unescape(r["formatted"][t["content_start"]:t["content_end"]])
                        loss.update(masked.encode())
                        n_loss += len(masked)
                rows.append((r["conv_id"], len(r["turns"]), all_turns.hexdigest(), n_loss, loss.hexdigest(),
                             len(r["formatted"]), r["rewrites_at"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    i64, s = pa.int64(), pa.string()
    out = pa.schema([("conv_id", i64), ("n_turns", i64), ("turns_sha256", s), ("loss_chars", i64), ("loss_sha256", s),
                     ("formatted_chars", i64), ("rewrites_at", i64)])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, rewrites_at long")
