"""Conversations as budgeted windows of whole turns.

Turns are formatted once, with control strings inside texts escaped reversibly. Running sums of
their token counts choose where windows end: a window holds the system turn, a limited history of
turns already seen, and new turns, within ``budget`` tokens. Assistant texts of new turns are under the loss
mask; repeated ones are not, so each target counts once. A turn that is itself over the budget is the only
new one of its window, without history, and the window says so.

Turns are formatted and counted where they are read, so a very long conversation is tokenised by many tasks. The pass that
cuts windows streams over rows sorted by conversation and only adds up: a task holds the system turn, the history and one
window, never a whole conversation.

Defined cases: null text is empty, null role is the role "" and never a target; turns are ordered by
(turn, role, text) with nulls first, so ties and repeated rows have one order and are all kept; the null conv_id
is a conversation; a very long turn is one row in a worker; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.encoders import encoder

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that a model may read as markup; none may stand in a text unescaped.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)

WINDOWS = "conv_id long, window long, text string, n_context int, loss_spans array<struct<start:int,end:int>>, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    """A backslash before each backslash and inside each control string, after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends."""
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a window; start and end frame the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


class _Conversation:
    """Cuts one conversation's turns, given in order, into windows."""

    def __init__(self, conv_id, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.limit = conv_id, budget, history
        self.window, self.system, self.first = 0, None, True
        self.past: deque = deque()  # turns before this window's first new one, newest last
        self.past_tokens = 0
        self.context: list = []
        self.new: list = []
        self.tokens = 0

    def _remember(self, turn) -> None:
        self.past.append(turn)
        self.past_tokens += turn[3]
        while self.past and self.past_tokens > self.limit:
            self.past_tokens -= self.past.popleft()[3]

    def _close(self):
        text, spans = [], []
        at = 0
        for k, (body, start, end, _, target) in enumerate(self.context + self.new):
            if target and k >= len(self.context):
                spans.append({"start": at + start, "end": at + end})
            text.append(body)
            at += len(body)
        row = (self.conv_id, self.window, "".join(text), len(self.context), spans, self.tokens, self.tokens > self.budget)
        self.window += 1
        for t in self.new:
            if t is not self.system:
                self._remember(t)
        self.new = []
        return row

    def _open(self, turn) -> None:
        room = self.budget - turn[3] - (self.system[3] if self.system else 0)
        kept, used = deque(), 0
        for t in reversed(self.past):
            if used + t[3] > room:
                break
            used += t[3]
            kept.appendleft(t)
        self.context = ([self.system] if self.system else []) + list(kept)
        self.new = [turn]
        self.tokens = used + turn[3] + (self.system[3] if self.system else 0)

    def add(self, role: str, turn):
        """The window that ends before this turn, if one does."""
        done = None
        if not self.new:
            self._open(turn)
        elif self.tokens + turn[3] <= self.budget:
            self.new.append(turn)
            self.tokens += turn[3]
        else:
            done = self._close()
            self._open(turn)
        if self.first and role == "system":
            self.system = turn
        self.first = False
        return done

    def end(self):
        return self._close()


def windows(turns: DataFrame, path: str, budget: int = 1024, history: int = 256, target: str = "assistant") -> DataFrame:
    """Formatted windows of every conversation."""

    def size(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            formatted = [render(r or "", t or "")[0] for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(enc.values(formatted), pa.int64())], names=[*b.schema.names, "n"])

    def cut(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_context", pa.int32()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])
        conv, rows, held = None, [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            ids, roles, texts, sizes = (b.column(k).to_pylist() for k in ("conv_id", "role", "text", "n"))
            formatted = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            for c, r, (body, start, end), n in zip(ids, roles, formatted, sizes, strict=True):
                if conv is None or conv.conv_id != c:
                    if conv:
                        rows.append(conv.end())
                    conv = _Conversation(c, budget, history)
                if row := conv.add(r or "", (body, start, end, n, r == target)):
                    rows.append(row)
                    held += len(row[2])
                if held > 1 << 22 or len(rows) >= 4096:
                    if rows:
                        yield pack()
                    rows, held = [], 0
        if conv:
            rows.append(conv.end())
        if rows:
            yield pack()

    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    t = t.mapInArrow(size, "conv_id long, turn long, role string, text string, n long")
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(cut, WINDOWS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows hold, by conversation, parsed back from their text: each turn and each target once."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        now, rows = None, []

        def close():
            return {"conv_id": now["id"], "n_turns": now["n"], "turns_sha256": now["turns"].hexdigest(), "loss_chars": now["chars"], "loss_sha256": now["loss"].hexdigest(), "formatted_chars": now["size"], "n_windows": now["w"]}

        for b in batches:
            for w in b.to_pylist():
                if now is None or now["id"] != w["conv_id"]:
                    if now:
                        rows.append(close())
                    now = {"id": w["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "w": 0}
                now["size"] += len(w["text"])
                now["w"] += 1
                for role, text, _, _ in parse(w["text"])[w["n_context"] :]:
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                for s in w["loss_spans"]:
                    text = unescape(w["text"][s["start"] : s["end"]])
                    now["chars"] += len(text)
                    now["loss"].update(text.encode())
            if len(rows) > 4096:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if now:
            rows.append(close())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read, DIGEST)
