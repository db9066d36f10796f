"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Running sums of turn tokens decide where a window ends: it takes turns while they,
the retained system turn and the repeated history fit `budget`. Every window but the first opens with the system turn (if the
conversation opens with one) and the last earlier turns that fit `history`; these are repeated, so the loss mask leaves them out.
The mask covers the text of every assistant turn in the one window where it is new. A turn is never cut: one that is over the budget
has a window of its own, marked `over`. A turn counts with all its template writes for it; turns open with a mark and end with a
newline, between which no token reaches, so a window has just as many tokens as its turns together.

Template: <|im_start|>ROLE newline TEXT<|im_end|> newline. In texts and roles "<|" gets a backslash between its characters, one more if
backslashes stand there already, so that no text can end a turn, and every text can be read back; in roles a newline is written \\n.

Distribution: rows are dealt by conversation and sorted by turn; tasks stream over them and hold one window and its history, so a
conversation may be of any length. Its digests run along the rows in order, which one task must do, in constant memory.

Defined results: null texts and roles are empty; a null conv_id is a conversation; turns that tie are ordered by role, then text; repeated rows are
turns. Only conv_id, turn, role and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_arrow, partitions
from tidewheel.llm.packing import default_vocabulary, encoder

BUDGET, HISTORY = 2048, 256
START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, first_turn long, repeated int, n_turns int, n_tokens int, over boolean"
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_written(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_read(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def framed(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the template, and where its text starts and ends in it."""
    head, body = f"{START}{role_written(role)}\n", escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def turns(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(role_read(r), unescaped(t)) for r, t in _TURN.findall(window)]


class Writer:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv: int | None, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.recent: deque[tuple] = deque()
        self.recent_tokens = self.number = self.seen = 0
        self.open: list[tuple] = []
        self.repeat: list[tuple] = []
        self.tokens = 0

    def add(self, role: str, text: str, size: int) -> Iterator[tuple]:
        turn = (role, text, size)
        if self.open and self.tokens + turn[2] > self.budget:
            yield self.close()
            self.repeat = ([self.system] if self.system else []) + list(self.recent)
            self.tokens = sum(t[2] for t in self.repeat)
            # history gives way to a turn that fits without it
            while self.repeat and self.repeat[-1] is not self.system and self.tokens + turn[2] > self.budget:
                self.tokens -= self.repeat.pop(1 if self.system else 0)[2]
        if not self.seen and role == "system":
            self.system = turn
        else:
            self.recent.append(turn)
            self.recent_tokens += turn[2]
            while self.recent and self.recent_tokens > self.history:
                self.recent_tokens -= self.recent.popleft()[2]
        self.open.append(turn)
        self.tokens += turn[2]
        self.seen += 1

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.repeat, *self.open]):
            whole, lo, hi = framed(role, text)
            if k >= len(self.repeat) and role == "assistant":
                loss.append({"start": at + lo, "end": at + hi})
            parts.append(whole)
            at += len(whole)
        n = len(self.open)
        out = (self.conv, self.number, "".join(parts), loss, self.seen - n, len(self.repeat), n, self.tokens, self.tokens > self.budget)
        self.number, self.open = self.number + 1, []
        return out


def _batches(rows: Iterator[tuple], kinds: list, names: list[str], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `size` characters of their texts."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += 100 + sum(len(x) for x in r if isinstance(x, str))
        if chars > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """The windows of every conversation (conv_id, turn, role, text). loss: spans of the text, in code points, that are targets; repeated: how many opening turns are repeats."""
    path = vocabulary or default_vocabulary()
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = own.repartition(partitions(own.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        writer, count = None, encoder(path)
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if writer is None or writer.conv != conv:
                    if writer:
                        yield writer.close()
                    writer = Writer(conv, budget, history)
                yield from writer.add(role, text, len(count.encode(framed(role, text)[0], allowed_special="all")))
        if writer:
            yield writer.close()

    names = [x.split()[0] for x in re.split(r", (?=\w+ )", WINDOWS)]
    return map_arrow(dealt, lambda batches: _batches(rows(batches), _KINDS, names), WINDOWS)


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What windows() wrote, read back: for each conversation its turns' digest, the digest and length of all text under the loss mask, and the characters of its windows. in_order: formatted comes straight from windows(), whose tasks hold whole conversations in order; nothing is shuffled again."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    dealt = formatted.select("conv_id", "window", "text", "loss", "repeated")
    if not in_order:
        dealt = dealt.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state = None
        for b in batches:
            for conv, text, loss, repeated in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss", "repeated")), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        yield (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                for span in loss:
                    own = unescaped(text[span["start"] : span["end"]])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(text)
        if state:
            yield (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

    return map_arrow(dealt, lambda batches: _batches(rows(batches), kinds, names), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
