"""Chat formatting in budgeted windows, streamed over turns that are sorted by conversation.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts get one more backslash
between ``<`` and ``|``, which :func:`unescape` takes away, so no text can look like a mark. A running sum of the turns'
tokens closes a window where the next turn would go over the budget; spans always begin and end at a turn. Every window
after the first repeats the system turn (the conversation's first turn, if its role is system) and the last turns of
the window before, as many as fit a quarter of the budget; repeated turns are never targets, so each assistant text is
under the loss mask once.

A turn that alone is over the budget gets a window of its own turns, whole. A task holds one window, not one
conversation.

Defined cases: a null text or role counts as empty; rows of one conversation and turn go by role, then text; a null turn
comes first; a null conversation is a conversation of its own; a repeated row is a turn of its own; other columns are
ignored, whatever their names; a text of any length is whole; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_TOKEN = re.compile(r"\w+|[^\w\s]")
WINDOWS = "conv_id long, window int, text string, n_tokens long, n_history int, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: "<" + m[1][1:] + "|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(text: str) -> int:
    """Words and marks: what the default budget counts."""
    return sum(1 for _ in _TOKEN.finditer(text))


class _Windows:
    """One conversation's windows, given its turns one at a time."""

    def __init__(self, conv: int | None, budget: int, count: Callable[[str], int]):
        self.conv, self.budget, self.count = conv, budget, count
        self.system: tuple[str, str, int, bool] | None = None
        self.own: list[tuple[str, str, int, bool]] = []
        self.history: list[tuple[str, str, int, bool]] = []
        self.sum, self.n, self.first = 0, 0, True

    def add(self, role: str, text: str) -> Iterator[tuple]:
        body = f"{escape_role(role)}\n"
        turn = (body, escape(text), self.count(text) + 4, role == "assistant")
        if self.first:
            self.first = False
            if role == "system":
                self.system = turn
        if self.own and self.sum + turn[2] > self.budget:
            yield self.close()
            self.carry(turn[2])
        self.own.append(turn)
        self.sum += turn[2]

    def carry(self, coming: int) -> None:
        """Sets what the next window repeats: the system turn and the newest turns, within a quarter of the budget."""
        system = [self.system] if self.system else []
        room = min(self.budget // 4, self.budget - coming - sum(t[2] for t in system))
        back: list[tuple[str, str, int, bool]] = []
        for t in reversed(self.own):
            if t is self.system or room < t[2]:
                break
            room -= t[2]
            back.append(t)
        self.history, self.own = [*system, *reversed(back)], []
        self.sum = sum(t[2] for t in self.history)

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for t, target in [*((t, False) for t in self.history), *((t, t[3]) for t in self.own)]:
            head = f"{START}{t[0]}"
            if target:
                loss.append((at + len(head), at + len(head) + len(t[1])))
            parts.append(f"{head}{t[1]}{END}\n")
            at += len(parts[-1])
        self.n += 1
        return self.conv, self.n - 1, "".join(parts), self.sum, len(self.history), loss


def chat_windows(turns: DataFrame, budget: int = 2048, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """conv_id, window, text, n_tokens, n_history (turns repeated), loss (code point spans of the targets)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Windows | None = None
        names = [x.split(" ")[0] for x in ("conv_id", "window", "text", "n_tokens", "n_history", "loss")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        for b in batches:
            out, size = [], 0
            for conv, role, text in zip(b["conv_id"].array, b["role"], b["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Windows(conv, budget, count)
                for w in now.add(role, text):
                    out.append(w)
                    size += len(w[2])
                if size > 1 << 22:
                    yield frame(out)
                    out, size = [], 0
            if out:
                yield frame(out)
        if now is not None:
            yield frame([now.close()])

    return rows.mapInPandas(form, WINDOWS)


def read_windows(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: digests of its turns and of its targets.

    The windows may come in any order and from anywhere, a table that was written and read again included.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        now: list | None = None

        def done() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]

        for b in batches:
            out = []
            for conv, text, skip, loss in zip(b["conv_id"].array, b["text"], b["n_history"], b["loss"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= skip:
                        now[1] += 1
                        now[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for span in loss if loss is not None else ():
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
                now[6] += 1
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([done()], columns=names).astype({"conv_id": "Int64"})

    rows = windows.select("conv_id", "window", "text", "n_history", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
