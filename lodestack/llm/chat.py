"""Operator 4, chat formatting in budgeted windows.

A conversation's turns become training windows of at most `budget` tokens. Prefix sums of the turns' tokens choose each
window's span: a window holds the system turn (the conversation's first turn, where its role is system), up to `history`
turns that earlier windows had as targets, and as many new turns as fit; spans begin and end at turns. History shrinks
where it leaves no room for the next new turn. A turn that does not fit even alone with the system turn gets a window of
its own, which is over the budget and says so; no turn is cut or dropped. The loss mask covers the text of assistant turns
where they are new: repeated turns are masked, so each assistant text is a target exactly once.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` a turn. In roles and texts a backslash and the opening `<|` of control
strings are escaped (`\\\\`, `<\\|`), and line ends in roles (`\\n`), so what a text says cannot end a turn and reading back
is exact. Masks are spans of code points in the formatted string, around escaped text.

Conversations are sorted by (id, turn, role, text) within partitions and streamed: a task holds the turns of one conversation
and a few megabytes of windows, so a conversation must fit in a worker's memory.

Defined results: null texts and roles are empty ones; rows with equal turns come in the order of role and text; repeated
rows are turns of their own; rows without conv_id form one conversation; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
WINDOW = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, n_tokens long, n_history int, has_system boolean, over_budget boolean"
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text begins and ends."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a window."""
    out, at = [], 0
    while at < len(window):
        if not window.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = window.index("\n", at)
        end = window.index(END, line)
        out.append((unescape(window[at + len(START) : line]), unescape(window[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


def count_words(text: str) -> int:
    """Tokens of a turn where no tokenizer is given: words, and four for the template."""
    return len(text.split()) + 4


def spans(sums: list[int], budget: int, history: int, system: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window. sums[i]: tokens of the first i turns after the system turn."""
    from bisect import bisect_right

    new, n = 0, len(sums) - 1
    while new < n:
        room = budget - system
        begin = max(0, new - history)
        while begin < new and sums[new + 1] - sums[begin] > room:
            begin += 1
        end = max(new + 1, bisect_right(sums, sums[begin] + room) - 1)
        yield begin, new, end
        new = end


def windows_of(turns: list[tuple[str, str]], budget: int, history: int, count: Callable[[str], int]) -> Iterator[dict]:
    """The windows of one conversation of (role, text) turns."""
    head = turns[:1] if turns and turns[0][0] == "system" else []
    rest = turns[len(head) :]
    system = sum(count(t) for _, t in head)
    sums = [0]
    for _, t in rest:
        sums.append(sums[-1] + count(t))
    found = spans(sums, budget, history, system) if rest else iter([(0, 0, 0)])
    for k, (begin, new, end) in enumerate(found):
        text, size, loss = [], 0, []
        for i, (role, said) in enumerate([*head, *rest[begin:end]]):
            turn, a, b = formatted(role, said)
            if role == "assistant" and i >= len(head) + new - begin:
                loss.append({"start": size + a, "end": size + b})
            text.append(turn)
            size += len(turn)
        tokens = system + sums[end] - sums[begin]
        yield {"window": k, "text": "".join(text), "loss": loss, "n_tokens": tokens, "n_history": new - begin, "has_system": bool(head), "over_budget": tokens > budget}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) rows of sorted batches."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 4, count: Callable[[str], int] = count_words) -> DataFrame:
    """The windows (WINDOW) of all conversations (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for conv, turns in groupby(_conversations(batches), key=lambda r: r[0]):
            for w in windows_of([(role, text) for _, role, text in turns], budget, history, count):
                held.append({"conv_id": conv} | w)
                size += len(w["text"])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(span)), ("n_tokens", pa.int64()), ("n_history", pa.int32()), ("has_system", pa.bool_()), ("over_budget", pa.bool_())])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, WINDOW)


def read_back(windows: Iterable[dict]) -> dict:
    """What the windows of one conversation, in order, say: turns and targets, from the formatted text and the masks alone."""
    turns, loss, n, chars, loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for k, w in enumerate(windows):
        found = parse(w["text"])
        chars += len(w["text"])
        skip = w["n_history"] + (1 if w["has_system"] else 0)
        for i, (role, text, _, _) in enumerate(found):
            if i >= skip or (k == 0 and i == 0):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for s in w["loss"]:
            said = unescape(w["text"][s["start"] : s["end"]])
            loss_chars += len(said)
            loss.update(said.encode("utf-8", "surrogatepass"))
    return {"n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}


def digests(windows: DataFrame) -> DataFrame:
    """conv_id and read_back() of each conversation's windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [{"conv_id": conv} | read_back(found) for conv, found in groupby(rows(batches), key=lambda w: w["conv_id"])]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
