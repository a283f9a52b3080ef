r"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans; each window repeats the latest system
turn and a limited history, and its loss mask covers only the assistant turns that are new in it. Every window repeats the system
turn whole: where it is over half the budget, the windows of its conversation hold up to twice its size instead of the budget, so
that as much new text stands beside it and the output stays within a constant factor of the input.

Template of a turn: ``### <role>: <text></turn>\n``. In roles and texts a backslash is put before every
backslash, ``#``, ``<`` and ``:``, so that no control string occurs inside them and unescaping is exact.

Rows of one conversation are ordered by turn, then role, then text; a null turn comes first, a null role
or text is the empty string, and repeated rows are separate turns. A turn longer than the budget stands
alone in its window, whole. Rows stream through sorted partitions, so a conversation of any length needs
the memory of one window. An empty table gives an empty result; only conv_id, turn, role and text are read, whatever the
other columns are called.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import small_batches

BUDGET, HISTORY, SYSTEM, TARGET = 512, 128, "system", "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
ESCAPE, UNESCAPE = re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
WINDOWS = "conv_id long, window long, formatted string, n_repeated int, n_turns int, loss array<struct<start:int,end:int>>"


def escape(s: str) -> str:
    return ESCAPE.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return UNESCAPE.sub(r"\1", s)


def tokens(role: str, text: str) -> int:
    """Budgeted size of a turn: its words and one for the mark."""
    return len(text.split()) + 1


def render(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[dict[str, int]]]:
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"### {escape(role)}: ", escape(text)
        if role == TARGET and i >= repeated:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), loss


class Windows:
    """Windows of one conversation, given its turns in order; keeps the system turn, the history and the open span. Sizes of spans
    are differences of prefix sums: turns a and later are shown, b and later are new."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str] | None = None
        self.system_size, self.turns, self.sums, self.a, self.b = 0, [], [0], 0, 0

    @property
    def new(self) -> bool:
        return self.b < len(self.turns)

    def room(self, size: int) -> int:
        """Tokens left beside the system turn and a turn of ``size``."""
        return max(self.budget, 2 * self.system_size) - self.system_size - size

    def add(self, role: str, text: str) -> Iterator[tuple[str, int, int, list]]:
        size = tokens(role, text)
        room = self.room(size)
        if self.new and self.sums[-1] - self.sums[self.a] > room:
            yield self.close()
            room = self.room(size)
        if not self.new:  # give up the oldest history that doesn't fit beside the coming turn
            self.a = min(self.b, max(self.a, bisect_left(self.sums, self.sums[-1] - max(0, room))))
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + size)

    def close(self) -> tuple[str, int, int, list]:
        shown = [*([self.system] if self.system else []), *self.turns[self.a :]]
        repeated = len(shown) - (len(self.turns) - self.b)
        text, loss = render(shown, repeated)
        last = next((i for i in range(len(self.turns) - 1, self.b - 1, -1) if self.turns[i][0] == SYSTEM), None)
        if last is not None:  # repeated from now on instead of the one before
            self.system, self.system_size = self.turns[last], self.sums[last + 1] - self.sums[last]
            self.a = last + 1
        keep = max(self.a, bisect_left(self.sums, self.sums[-1] - self.history))
        self.turns, self.sums = self.turns[keep:], self.sums[keep:]
        self.a, self.b = 0, len(self.turns)
        return text, repeated, len(shown), loss


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window, in order within its conversation; one shuffle, by conversation."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), kind]
        names = [x.split()[0] for x in WINDOWS.split(", ")]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        conv, open_, number, out, size = None, None, 0, [], 0
        for b in it:
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if open_ is None or c != conv:
                    if open_ is not None and open_.new:
                        out.append((conv, number, *open_.close()))
                    conv, open_, number = c, Windows(budget, history), 0
                for w in open_.add(role, text):
                    out.append((conv, number, *w))
                    number += 1
                    size += len(w[0])
                if len(out) >= 500 or size > 1 << 22:
                    if out:
                        yield batch([(a, n, t, r, k, z) for a, n, t, r, k, z in out])
                    out, size = [], 0
        if open_ is not None and open_.new:
            out.append((conv, number, *open_.close()))
        if out:
            yield batch(out)

    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows hold. ``windows`` must be ordered within partitions as format_chats leaves them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, state = [], None, None

        def close() -> None:
            if state:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in it:
            for c, w, text, repeated, loss in zip(*(b.column(k).to_pylist() for k in ("conv_id", "window", "formatted", "n_repeated", "loss")), strict=True):
                if state is None or c != conv or w == 0:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in list(TURN.finditer(text))[repeated:]:
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for x in loss:
                    said = unescape(text[x["start"] : x["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if out:
                yield batch()
                out = []
        close()
        if out:
            yield batch()

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
