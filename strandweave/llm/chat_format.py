"""Chat formatting: token-budgeted, turn-aligned windows with history and a loss mask.

A turn is rendered as ``<|start|>role<|sep|>text<|end|>\\n``. Control strings inside roles and
texts, this template's and those of other public ones, get a backslash after their first
character (one more if they have some already), so markers never come from data and
:func:`unescape` gives the text back exactly.

Prefix sums of turn tokens choose the spans: a window takes turns from the first not yet
shown while their tokens, with the system turn and the history in front, fit ``budget``. The
system turn that opens a conversation is in front of every window; up to ``history`` tokens
of whole turns before the span follow it. The loss mask covers assistant texts of the span
only, so repeated turns are masked and each assistant text is a target once. A turn that
alone exceeds the budget has a window of its own, whole.

Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one
order and all count. Null texts and roles are empty. Null ids form one conversation. An empty
table gives an empty result; other columns are ignored, whatever their names. Windows are
made in one pass over sorted partitions; memory is one window's turns, so a very long text
is held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tokenization import CachedEncoder

#: The template's markers, then control strings of other public chat templates.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
_CONTROL = r"(?:<(?P<a>\\*)(?=\|[a-z_]+\|>|/?s>|</?SYS>>)|\[(?P<b>\\*)(?=/?INST\]))"
_ESCAPE = re.compile(_CONTROL)
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + r"\n", re.S)

BUDGET, HISTORY = 1024, 256
_SCHEMA = "conv_id long, window long, n_turns long, n_repeated long, n_tokens long, text string, loss array<struct<start:long,`end`:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() if len(m.group()) == 1 else m.group()[0] + m.group()[2:], text)


def render(role: str, text: str) -> str:
    return f"{START}{escape(role)}{SEP}{escape(text)}{END}\n"


class _Conversation:
    """Turns of one conversation since the current span began, and what may stand before it."""

    def __init__(self, conv_id, budget: int, history: int):
        self.id, self.budget, self.history_budget = conv_id, budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []
        self.span: list[tuple] = []
        self.front = self.prefix = 0
        self.window = 0
        self.begun = False

    def _history(self) -> None:
        """The longest run of whole turns before the span within the history budget, by suffix sums."""
        sizes = np.cumsum([t[2] for t in reversed(self.past)])
        self.past = self.past[len(self.past) - int(np.searchsorted(sizes, self.history_budget, "right")) :]

    def add(self, role: str, text: str, size: int) -> Iterator[tuple]:
        turn = (role, text, size)
        if not self.begun and role == "system":
            self.begun, self.system, self.front = True, turn, size
            return
        self.begun = True
        if self.span and self.prefix + size > self.budget:
            yield self.close()
        if not self.span:
            self._history()
            room = self.budget - self.front - size
            while self.past and sum(t[2] for t in self.past) > room:
                self.past.pop(0)
            self.prefix = self.front + sum(t[2] for t in self.past)
        self.span.append(turn)
        self.prefix += size

    def close(self) -> tuple:
        first = self.window == 0
        shown = ([self.system] if self.system else []) + self.past + self.span
        new = len(self.span) + (1 if first and self.system else 0)
        out, at, loss = [], 0, []
        for i, (role, text, _) in enumerate(shown):
            piece = render(role, text)
            if role == "assistant" and i >= len(shown) - len(self.span):
                begin = at + len(START) + len(escape(role)) + len(SEP)
                loss.append({"start": begin, "end": at + len(piece) - len(END) - 1})
            out.append(piece)
            at += len(piece)
        row = (self.id, self.window, new, len(shown) - new, sum(t[2] for t in shown), "".join(out), loss)
        self.past, self.span, self.window = self.past + self.span, [], self.window + 1
        return row


def format_windows(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, n_tokens, text, loss) of ``conversations`` (conv_id, turn, role, text)."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = CachedEncoder(tokenizer_path, cache_pieces=100_000)
        current: _Conversation | None = None
        names = ["conv_id", "window", "n_turns", "n_repeated", "n_tokens", "text", "loss"]
        for pdf in batches:
            rows: list[tuple] = []
            for conv_id, role, text in zip(pdf["conv_id"].tolist(), pdf["role"].tolist(), pdf["text"].tolist(), strict=True):
                conv_id = None if conv_id is None or conv_id != conv_id else int(conv_id)
                if current is None or current.id != conv_id:
                    if current is not None and (current.span or current.system and not current.window):
                        rows.append(current.close())
                    current = _Conversation(conv_id, budget, history)
                size = len(encoder.encode([render(role, text)])[0]) // 4
                rows.extend(current.add(role, text, size))
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if current is not None and (current.span or current.system and not current.window):
            yield pd.DataFrame([current.close()], columns=names)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # ids travel as strings of digits so that a null one doesn't turn the others into floats
    return ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text").mapInPandas(windows, _SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Each conversation's turns and targets as digests, parsed from the formatted windows."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list | None = None

        def told() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for pdf in batches:
            rows = []
            for conv_id, repeated, text, loss in zip(pdf["conv_id"].tolist(), pdf["n_repeated"].tolist(), pdf["text"].tolist(), pdf["loss"].tolist(), strict=True):
                conv_id = None if conv_id is None or conv_id != conv_id else int(conv_id)
                if state is None or state[0] != conv_id:
                    if state is not None:
                        rows.append(told())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = _TURN.findall(text)
                for role, body in turns[repeated:]:  # repeated turns come first
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if state is not None:
            yield pd.DataFrame([told()], columns=names)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "n_repeated", "text", "loss").mapInPandas(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

