"""Chat formatting in budgeted windows."""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_arrow_batches, table
from .tokens import coder, default_tokenizer

BUDGET, HISTORY = 1024, 256
_CONTROL = re.compile(r"(?<=<)(\\*)(?=/?s>)|(?<=\[)(\\*)(?=/?INST\])")
_ESCAPED = re.compile(r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>\n", re.S)
WINDOWS = "conv_id long, window int, text string, n_repeated int, loss array<struct<start:int,end:int>>, n_tokens long"
_ROWS, _CHARS = 500, 4 << 20


def escape(text: str) -> str:
    """Put a backslash after the first character of each control string, and of each that already has some there."""
    return _CONTROL.sub(lambda m: (m[1] or m[2] or "") + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its text stands in it."""
    head = f"<s>[INST]{escape(role)}[/INST]"
    body = escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


class _Conversation:
    """Windows of one conversation, from its turns in order; holds one window and the history only.

    ``sums`` are the prefix sums of turn tokens at the ends of the held turns, so
    a span's tokens are the difference of two of them.
    """

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system = None
        self.past: deque = deque()  # (turn, tokens) before the window's first new turn
        self.past_tokens = 0
        self.new: list = []
        self.sums = [0]
        self.windows = self.turns = 0

    def add(self, role: str, text: str, count):
        marked = *format_turn(role, text), role
        tokens = count(marked[0])
        shut = None
        fixed = self.system[1] if self.system else 0
        if self.new and fixed + self.past_tokens + self.sums[-1] + tokens > self.budget:
            shut = self.close()
            fixed = self.system[1] if self.system else 0
        if not self.new:
            while self.past and fixed + self.past_tokens + tokens > self.budget:
                self.past_tokens -= self.past.popleft()[1]
        self.new.append((marked, tokens))
        self.sums.append(self.sums[-1] + tokens)
        if not self.turns and role == "system":
            self.first_is_system = True
        self.turns += 1
        return shut

    first_is_system = False

    def close(self):
        repeated = ([self.system] if self.system else []) + list(self.past)
        text, loss, at = [], [], 0
        for i, ((marked, a, b, role), _) in enumerate(repeated + self.new):
            text.append(marked)
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": at + a, "end": at + b})
            at += len(marked)
        tokens = (self.system[1] if self.system else 0) + self.past_tokens + self.sums[-1]
        row = (self.conv_id, self.windows, "".join(text), len(repeated), loss, tokens)
        turns = self.new
        if self.first_is_system and not self.windows:
            self.system, turns = turns[0], turns[1:]
        for turn in turns:
            self.past.append(turn)
            self.past_tokens += turn[1]
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[1]
        self.new, self.sums = [], [0]
        self.windows += 1
        return row


_NONE = object()


def _format(path: str, budget: int, history: int):
    def run(frames):
        ids = coder(path).ids
        names = [c.split()[0] for c in re.sub(r"<.*>", "", WINDOWS).split(", ")]
        count = lambda marked: len(ids(marked)) // 4
        now, was, out, held = None, _NONE, [], 0
        for f in frames:
            for conv, known, role, text in zip(f.conv_id.fillna(0).astype("int64"), f.conv_id.notna(), f.role, f.text):
                conv = int(conv) if known else None
                if conv != was or now is None:
                    if now:
                        out.append(now.close())
                    now, was = _Conversation(conv, budget, history), conv
                if row := now.add(role or "", text or "", count):
                    out.append(row)
                held += len(text or "")
                if len(out) >= _ROWS or out and held >= _CHARS:
                    yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                    out, held = [], 0
        if now:
            out.append(now.close())
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    return run


def format_chats(turns: DataFrame, path: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> a row for each window: ``conv_id, window, text, n_repeated, loss, n_tokens``.

    Turns stand in the order of ``turn`` (then role and text), each as
    ``<s>[INST]role[/INST]text</s>``; these control strings are escaped inside
    roles and texts.  A window takes whole turns while the prefix sums of their
    tokens stay within ``budget``; a turn longer than that stands alone with the
    system turn.  Later windows begin with the system turn and the last turns
    within ``history`` tokens, ``n_repeated`` in all.  ``loss`` holds the
    places of assistant texts, of new turns only.

    Conversations are dealt by id and read as a sorted stream, so a long one
    takes no more memory than a window.  Null role or text is empty; null
    ``conv_id`` is one conversation; repeated rows are turns; an empty table
    has no windows.
    """
    small_arrow_batches(turns.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return (rows.repartition("conv_id").sortWithinPartitions(*keys)
            .mapInPandas(_format(path or default_tokenizer(), budget, history), WINDOWS))


def _digest(frames):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    was, now, out = _NONE, None, []

    def end():
        out.append((was, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]))

    for f in frames:
        for conv, known, text, repeated, loss in zip(f.conv_id.fillna(0).astype("int64"), f.conv_id.notna(), f.text, f.n_repeated, f.loss):
            conv = int(conv) if known else None
            if now is None or conv != was:
                if now:
                    end()
                was, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse_turns(text)[repeated:]
            now[0] += len(turns)
            for role, body in turns:
                now[1].update(f"{role}\n{body}\n".encode())
            for span in loss:
                target = unescape(text[span["start"]:span["end"]])
                now[2] += len(target)
                now[3].update(target.encode())
            now[4] += len(text)
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        out.clear()
    if now:
        end()
    yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation's turns and of its text under the loss mask, parsed from the windows."""
    return (windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
            .mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def op9_chat_format(spark, sf_dir):
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text"
                      " FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(probe)))
