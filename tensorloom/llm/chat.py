"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of at most ``budget`` tokens.
Running sums of the turns' tokens choose where a window ends, always between
turns.  Each later window begins with the system turn, where it fits beside the
next turn, and with the last few turns before it, as far as ``history`` allows;
these repeated turns are context and carry no loss.  Every assistant turn is a
target in exactly one window.

A turn is written ``<s>[role]``, a line end, its text, ``</s>`` and a line end.
Inside roles and texts the characters ``\\``, ``<``, ``[`` and ``]`` are preceded
by a backslash, so no text can look like a mark and every text can be read back.

Defined cases: null texts and roles are empty.  Turns are ordered by turn, nulls
first, then role and text; repeated rows are turns of their own.  A turn larger
than the budget gets a window by itself, whole and without context; no other
window exceeds the budget.  Very long texts are whole, too.  Rows with a null conv_id form
one conversation.  An empty table gives an empty result.  Other columns play no
part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import Encoder, tokenizer_path

BUDGET = 1024
#: Turns repeated before a later window at most, and the share of the budget that they may take.
HISTORY_TURNS, HISTORY_SHARE = 2, 0.25
#: Tokens that a turn's marks are counted as.
MARK_TOKENS = 8

_SPECIAL = re.compile(r"[\\<\[\]]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[((?:[^\\<\[\]]|\\.)*)\]\n((?:[^\\<\[\]]|\\.)*)</s>\n", re.DOTALL)

WINDOW_SCHEMA = "conv_id long, window long, formatted string, n_tokens long, context_turns long, loss_begin array<long>, loss_end array<long>"


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = f"<s>[{escape(role)}]\n"
    body = escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the text's place of each turn; an error if a rest is left."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


class Windows:
    """Cuts one conversation's turns, given in order, into windows."""

    def __init__(self, budget: int, history_turns: int, history_share: float):
        self.budget, self.turns, self.share = budget, history_turns, int(budget * history_share)
        self.system: tuple | None = None
        self.last: deque = deque(maxlen=max(1, history_turns))
        self.context: list[tuple] = []
        self.new: list[tuple] = []
        self.prefix = [0]  # running sums of the tokens of the window's turns
        self.any = False

    def _open(self, tokens: int) -> None:
        """Begin a window: the system turn, then what history has room beside ``tokens``."""
        system = [self.system] if self.system and self.system[3] + tokens <= self.budget else []
        history, held = [], sum(t[3] for t in system)
        for t in reversed(self.last if self.turns else ()):
            if t is self.system or tokens > self.budget or sum(h[3] for h in history) + t[3] > self.share or held + t[3] + tokens > self.budget:
                break
            history.insert(0, t)
            held += t[3]
        self.context = system + history
        self.new, self.prefix = [], [0]
        for t in self.context:
            self.prefix.append(self.prefix[-1] + t[3])

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Take a turn; a window that it closes is returned."""
        turn = (role, text, len(text), tokens)
        out = None
        if self.new and self.prefix[-1] + tokens > self.budget:
            out = self.close()
            self._open(tokens)
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + tokens)
        if not self.any and role == "system":
            self.system = turn
        self.any = True
        self.last.append(turn)
        return out

    def close(self) -> tuple | None:
        """Formatted text, tokens, context turns, and the places under the loss."""
        if not self.new:
            return None
        parts, begin, end, at = [], [], [], 0
        for k, (role, text, _, _) in enumerate([*self.context, *self.new]):
            piece, a, b = turn_text(role, text)
            if role == "assistant" and k >= len(self.context):
                begin.append(at + a)
                end.append(at + b)
            parts.append(piece)
            at += len(piece)
        out = ("".join(parts), self.prefix[-1], len(self.context), begin, end)
        self.context, self.new, self.prefix = [], [], [0]
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "window", "formatted", "n_tokens", "context_turns", "loss_begin", "loss_end"])


def format_windows(conversations: DataFrame, *, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE, tokenizer: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_tokens, context_turns, loss_begin, loss_end.

    Conversations stream through their partition in order; only the open
    window, the system turn and the history are held.
    """
    path = tokenizer or tokenizer_path()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        encoder = Encoder.of(path)
        now, windows, number = object(), None, 0
        for batch in slices(batches, "text"):
            out = []

            def put(window):
                nonlocal number
                if window:
                    out.append((now, number, *window))
                    number += 1

            texts = batch.column("text").to_pylist()
            for conv, role, text, ids in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), texts, encoder.encode(texts), strict=True):
                if windows is None or conv != now:
                    if windows:
                        put(windows.close())
                    now, windows, number = conv, Windows(budget, history_turns, history_share), 0
                put(windows.add(role, text, len(ids) // 4 + MARK_TOKENS))
            yield _batch(out)
        if windows and (last := windows.close()):
            yield _batch([(now, number, *last)])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, one row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    and n_windows; context turns are skipped, since they are said already.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches):
        state = None

        def done():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])

        for batch in slices(batches, "formatted"):
            out = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != state[0]:
                    if state:
                        out.append(done())
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = parse(r["formatted"])[r["context_turns"] :]
                for role, text, _, _ in turns:
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(r["loss_begin"], r["loss_end"], strict=True):
                    target = unescape(r["formatted"][a:b])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[1] += len(turns)
                state[5] += len(r["formatted"])
                state[6] += 1
            yield pack(out)
        if state:
            yield pack([done()])

    def pack(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
