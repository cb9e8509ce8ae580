"""Chat formatting: conversations cut into turn-aligned windows under a token budget.

A turn becomes `<turn ROLE>`, a line break, its text, `</turn>` and a line
break; in roles and texts a backslash goes before every backslash, `<` and
`>`, so no text can close or open a turn and reading back restores it exactly.

Prefix sums of the turns' tokens choose each window: it starts with the
conversation's system turn (its first turn, if of that role), repeats as many
of the last turns as fit HISTORY tokens, and takes new turns while the sum
stays within the budget. Each turn is new in exactly one window. Loss spans
cover the text of new assistant turns only, so repeats are masked. A turn that
exceeds the budget alone gets a window for itself and is marked, not cut.

Rows are sorted by conversation and turn and then streamed: a worker holds one
window's turns, however long a conversation is. Turns of one number keep the
order of role and text; a null turn number comes first, null role and text are
empty, a null conversation id is a conversation of its own, repeated rows are
turns like any other. Other columns are ignored, whatever their names. No rows
give no windows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import as_bytes, mapped, session
from granary.llm.fertility import vocabulary

BUDGET, HISTORY = 1024, 256
VOCABULARY = "byte_bpe_50k.tiktoken"
WINDOWS = (
    "conv_id bigint, window int, text string, n_context int, n_turns int, n_tokens bigint, "
    "over_budget boolean, loss array<struct<start:int,end:int>>"
)
DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
SYSTEM, TRAINED = "system", "assistant"

_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    r"<turn (?P<role>[^\\<>]*+(?:\\.[^\\<>]*+)*+)>\n(?P<text>[^\\<>]*+(?:\\.[^\\<>]*+)*+)</turn>\n", re.DOTALL
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Turn:
    """A formatted turn, the place of its text in it, and its tokens."""

    def __init__(self, role: str, text: str, tokens) -> None:
        head, body = f"<turn {escape(role)}>\n", escape(text)
        self.role, self.formatted = role, f"{head}{body}</turn>\n"
        self.start, self.end = len(head), len(head) + len(body)
        self.tokens = len(tokens(self.formatted))


def turn_windows(turns: Iterator[Turn], budget: int, history: int) -> Iterator[tuple]:
    """The fields of WINDOWS after conv_id, window by window."""
    system: list[Turn] = []
    context: list[Turn] = []
    new: list[Turn] = []
    number = used = 0
    for k, turn in enumerate(turns):
        if new and used + turn.tokens > budget:
            yield _window(number, context, new, budget)
            if not number and system:
                new = new[1:]
            number += 1
            context = system + _recent(new, min(history, budget - _sum(system) - turn.tokens))
            new, used = [], _sum(context)
        if not k and turn.role == SYSTEM:
            system = [turn]
        new.append(turn)
        used += turn.tokens
    if new:
        yield _window(number, context, new, budget)


def _sum(turns: list[Turn]) -> int:
    return sum(t.tokens for t in turns)


def _recent(turns: list[Turn], room: int) -> list[Turn]:
    """The longest run of last turns of at most room tokens."""
    sums = list(accumulate((t.tokens for t in turns), initial=0))
    return turns[bisect_left(sums, sums[-1] - max(room, 0)) :]


def _window(number: int, context: list[Turn], new: list[Turn], budget: int) -> tuple:
    turns = context + new
    starts = list(accumulate((len(t.formatted) for t in turns), initial=0))
    loss = [
        {"start": at + t.start, "end": at + t.end}
        for at, t in list(zip(starts, turns, strict=False))[len(context) :]
        if t.role == TRAINED
    ]
    tokens = _sum(turns)
    return number, "".join(t.formatted for t in turns), len(context), len(turns), tokens, tokens > budget, loss


def _grouped(batches: Iterator[list[tuple]]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Runs of equal first fields, over the borders of batches."""
    from itertools import groupby

    return groupby((row for batch in batches for row in batch), key=lambda r: r[0])


def _chunks(rows: Iterator[tuple], size: int = 256) -> Iterator[list[tuple]]:
    chunk: list[tuple] = []
    for r in rows:
        chunk.append(r)
        if len(chunk) >= size:
            yield chunk
            chunk = []
    yield chunk


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", name: str = VOCABULARY,
) -> DataFrame:
    """One row per window, with the fields of WINDOWS, sorted by conversation and window within a partition."""
    session(turns)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        encoder, _ = vocabulary(name)

        def rows() -> Iterator[tuple]:
            for key, group in _grouped(batches):
                made = (
                    Turn(r[1].decode("utf-8", "replace"), r[2].decode("utf-8", "replace"), encoder.encode_ordinary)
                    for r in group
                )
                for w in turn_windows(made, budget, history):
                    yield (key, *w)

        return _chunks(rows())

    named = turns.select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("n"), as_bytes(role).alias("r"), as_bytes(text).alias("t")
    )
    ordered = named.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    return mapped(ordered.select("c", "r", "t"), run, WINDOWS)


def read_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m["role"]), unescape(m["text"])))
        at = m.end()
    return out


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from their text and loss spans.

    windows comes in the order that format_windows gives.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        def rows() -> Iterator[tuple]:
            for key, group in _grouped(batches):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                for _, text, n_context, spans in group:
                    for role, said in read_window(text)[n_context:]:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        learnt = unescape(text[s["start"] : s["end"]])
                        loss.update(learnt.encode())
                        loss_chars += len(learnt)
                    chars += len(text)
                yield key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        return _chunks(rows())

    return mapped(windows.select("conv_id", "text", "n_context", "loss"), run, DIGEST)
