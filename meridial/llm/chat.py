"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose spans of whole turns that fit a budget. Every
window after the first repeats the conversation's system turn and a limited
history of the turns before it, both masked; the turns that are new in a window
follow, and of these the assistant's are the targets. So each assistant text is
a target in exactly one window.

The template is ``<turn role="...">`` newline, text, ``</turn>`` newline. In
roles and texts a backslash is written ``\\\\`` and ``<`` is written ``\\l``, a
double quote in a role ``\\q``, so no control string can stand inside a text and
reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.llm._work import partitions

OPEN, CLOSE = '<turn role="', "</turn>\n"
_TURN = re.compile(r'<turn role="([^"]*)">\n([^<]*)</turn>\n')
_CODES = {"\\\\": "\\", "\\l": "<", "\\q": '"'}


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\l")
    return text.replace('"', "\\q") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lq]", lambda m: _CODES[m[0]], text)


def tokens(text: str) -> int:
    """Words of a text, by which budgets are counted; 4 more stand for the template."""
    return len(text.split()) + 4


class WindowMaker:
    """Turns of one conversation after the other, in order, to windows.

    Only the turns of the window at hand, the repeated history and the system
    turn are held. A turn over the budget has a window of its own, uncut.
    """

    def __init__(self, budget: int = 1024, history: int = 2, history_budget: int = 256):
        self.budget, self.history, self.history_budget = budget, history, history_budget

    def start(self, conversation) -> None:
        self.conversation, self.number, self.system = conversation, 0, None
        self.new: list[tuple[str, str]] = []
        self.context: list[tuple[str, str]] = []
        self.used = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        size = tokens(text)
        if self.new and self.used + size > self.budget:
            yield self.window()
            self._carry()
        if self.system is None and role == "system":
            self.system = (role, text)
        self.new.append((role, text))
        self.used += size

    def _carry(self) -> None:
        """The last turns that fit the history's budget are repeated."""
        kept, size = [], 0
        for role, text in reversed((self.context + self.new)[-self.history :] if self.history else []):
            size += tokens(text)
            if size > self.history_budget:
                break
            if (role, text) != self.system:
                kept.append((role, text))
        self.context, self.new = kept[::-1], []
        self.number += 1
        self.used = sum(tokens(t) for _, t in self.context) + (tokens(self.system[1]) if self.system else 0)

    def window(self) -> tuple:
        """(conversation, window, repeated turns, text, starts and ends of the loss mask)."""
        repeated = ([self.system] if self.system and self.number else []) + self.context
        parts, at, starts, ends = [], 0, [], []
        for i, (role, text) in enumerate(repeated + self.new):
            head, body = f'{OPEN}{escape(role, True)}">\n', escape(text)
            if role == "assistant" and i >= len(repeated):
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        return self.conversation, self.number, len(repeated), "".join(parts), starts, ends


_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def format_chats(conversations: DataFrame, **options) -> DataFrame:
    """Windows of all conversations: ``conv_id, window, n_repeated, formatted, loss_starts, loss_ends``.

    Takes ``conv_id, turn, role, text`` and reads the rows of a conversation by
    turn (null first; ties by role, then text). A null role or text is an empty
    string; rows with a null conv_id are one conversation. Loss spans are code
    points of ``formatted``, ends exclusive. The first ``n_repeated`` turns of a
    window were in windows before. Turns are sorted by Spark and streamed, so a
    conversation of any length takes bounded memory; the windows of a
    conversation stay in order in one partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, out, held, last = WindowMaker(**options), [], 0, ()
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if last != (conv,):
                    if last:
                        out.append(maker.window())
                    maker.start(conv)
                    last = (conv,)
                out += maker.add(role or "", text or "")
                held += len(text or "")
                if held > 1 << 22 and out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)
                    out, held = [], 0
        if last:
            out.append(maker.window())
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = turns.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.drop("turn").mapInArrow(rows, "conv_id bigint, window bigint, n_repeated bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its windows alone.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_windows``. Follows ``format_chats`` without a shuffle; a
    digest is sequential, so it is updated window by window.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        turns, loss, n = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]

        def done() -> tuple:
            return last[0], n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]

        for b in batches:
            out = []
            for conv, repeated, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_repeated", "formatted", "loss_starts", "loss_ends")), strict=True):
                if last != (conv,):
                    if last:
                        out.append(done())
                    last, turns, loss, n = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for role, said in parse(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n[0] += 1
                for a, z in zip(starts, ends, strict=True):
                    said = unescape(text[a:z])
                    loss.update(said.encode())
                    n[1] += len(said)
                n[2] += len(text)
                n[3] += 1
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
        if last:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(done(), _DIGESTS, strict=True)], schema=_DIGESTS)

    return windows.mapInArrow(rows, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
