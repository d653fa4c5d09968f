"""Chat formatting in budgeted windows, and reading it back.

Prefix sums of turn tokens choose spans of whole turns that fit a budget: where
a window ends, and where the turns that it repeats begin, are places found in
the sums. Each window begins with the conversation's system turn, repeats a
limited history before its own turns, and marks as loss only its own assistant
turns, so that every assistant text is a target once. Conversations are cut
into blocks of turns, which are formatted apart, so that a huge one is no task
of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import load
from .common import bounded_batches

#: Tokens of a window, of which at most so many are repeated turns other than the system's.
BUDGET, HISTORY = 512, 128
#: Turns of one block, which one task formats; turn numbers by which turns are first counted.
BLOCK = 4096
#: Control strings. Texts and roles have no bare "<" after escaping.
OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>"
_TURN = re.compile(r"<\|turn\|>([^<]*)<\|body\|>([^<]*)<\|end\|>")


def escape(text: str) -> str:
    """Make a text free of control strings, reversibly."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    """The inverse of escape."""
    return re.sub(r"\\(.)", lambda m: "<" if m[1] == "l" else m[1], text, flags=re.S) if "\\" in text else text


def quarter(text: str) -> int:
    """Tokens of a text where no vocabulary is given: one each four characters."""
    return (len(text) + 3) // 4


def framed(role: str, text: str) -> str:
    """One turn as it stands in a window."""
    return f"{OPEN}{escape(role)}{BODY}{escape(text)}{CLOSE}"


def plan(costs: np.ndarray, room: int, history: int, at: int = 0, first_room: int | None = None, low: int = 0) -> Iterator[tuple[int, int, int]]:
    """Windows over turns of given token costs, from turn ``at`` on: first repeated turn, first own turn, end.

    A window's own turns are the longest span that fits the room; the turns
    before it that are repeated, from ``low`` on, fit the history and make way
    for its first own turn. A turn over the room is a window of its own, without
    history. The first window may have a room of its own.
    """
    sums = np.append(0, np.cumsum(costs))
    while at < len(costs):
        width, first_room = room if first_room is None else first_room, None
        past = min(history, width - int(costs[at]))
        back = min(at, max(low, int(np.searchsorted(sums, sums[at] - past)))) if past > 0 else at
        end = max(at + 1, int(np.searchsorted(sums, sums[back] + width, "right")) - 1)
        yield back, at, end
        at = end


def render(conv: int | None, block: int | None, number: int, turns: list[tuple[str, str]], repeated: int) -> dict:
    """One window as text, with the spans of its own assistant texts."""
    parts, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
        if k >= repeated and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return {"conv_id": conv, "block": block, "window": number, "formatted": "".join(parts), "repeated": repeated, "loss": [{"begin": a, "end": b} for a, b in spans]}


WINDOW_SCHEMA = "conv_id long, block long, window int, formatted string, repeated int, loss array<struct<begin:int,end:int>>"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("repeated", pa.int32()), ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
)
#: Characters of turns that are held before they are formatted, and windows that are handed on together.
HELD_CHARS, SEND_CHARS = 8 << 20, 4 << 20


class _Block:
    """Turns of one block that are not all in windows yet, and the history before them."""

    def __init__(self, conv: int | None, block: int, system: str | None, limits: tuple[int, int], count: Callable[[str], int]):
        self.key, self.number, self.turns, self.costs, self.at, self.chars = (conv, block), 0, [], [], 0, 0
        self.limits, self.count = limits, count
        self.low = int(system is not None and block == 0)  # the first block has the system turn itself
        cost = 0 if system is None else count(framed("system", system))
        # one that leaves no room in any window is not repeated
        self.pin, self.pin_cost = ([("system", system)], cost) if 0 < cost < limits[0] else ([], 0)

    def add(self, role: str, text: str, past: bool) -> None:
        """Take a turn; those of the block before come first and are history only."""
        self.turns.append((role, text))
        self.costs.append(self.count(framed(role, text)))
        self.chars += len(text)
        self.at += past

    def windows(self, whole: bool) -> Iterator[dict]:
        """Windows of the turns held; where more turns may come, all but the last."""
        budget, history = self.limits
        room = budget - self.pin_cost
        own = self.low and not self.number  # the first window has the system turn itself
        spans = list(plan(np.array(self.costs, np.int64), max(1, room), history, self.at, budget if own else None, self.low))
        for back, at, end in spans if whole else spans[:-1]:
            pin = [] if self.low and not self.number else self.pin
            yield render(*self.key, self.number, pin + self.turns[back:end], len(pin) + at - back)
            self.number += 1
        if not whole and spans:
            back, at, _ = spans[-1]
            back = min(back, at)
            self.turns, self.costs, self.at, self.low = self.turns[back:], self.costs[back:], at - back, self.low if not self.number else 0
            self.chars = sum(len(t) for _, t in self.turns)


def window_spans(budget: int, history: int, vocabulary: bytes | None):
    """Map over sorted turns: the windows of each block of each conversation."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count = load(vocabulary).n_ids if vocabulary else quarter
        held: _Block | None = None
        for batch in batches:
            for who, block, role, text, system, past in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text", "system", "past")), strict=True):
                if held is None or held.key != (who, block):
                    if held:
                        yield from held.windows(True)
                    held = _Block(who, block, system, (budget, history), count)
                held.add(role, text, past)
                if held.chars > HELD_CHARS:
                    yield from held.windows(False)
        if held:
            yield from held.windows(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in windows(batches):
            rows.append(row)
            size += len(row["formatted"])
            if size > SEND_CHARS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Format conversations (conv_id, turn, role, text) as windows with loss spans.

    Returns conv_id, block, window (in the block), formatted, repeated (turns at
    its start that an earlier window has) and loss (character spans). A first
    turn with role system is repeated whole in every window (one that fills the
    budget alone is a window of its own, and is not repeated); turns before a
    window's own, of at most ``history`` tokens, are repeated behind it. Loss spans
    cover assistant texts as escaped, without their frame. A window's tokens are
    at most ``budget``, frames, roles and the system turn included, but where a
    single turn of its own is longer than what the system turn leaves: turns are
    never cut, and it then is alone with the system turn. Tokens are those of
    the vocabulary file at a path, or, with none, a quarter of the characters.
    Conversations are formatted in blocks of ``block`` turns, each of which also
    gets the turns before it that the history can hold.

    Null text or role: empty. Null conv_id: one conversation. Null turn: before
    all others; equal turns go by role, then text. Repeated rows: each is a
    turn. Empty table: no rows. Other columns are ignored.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    source = None
    if vocabulary:
        with open(vocabulary, "rb") as file:
            source = file.read()
    count = load(source).n_ids if source else quarter
    # turns that the history can hold: each has a frame at least
    edge = history // max(1, count(framed("", "")))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    # a turn's place: by parts of a conversation, then in its part, so that no task needs a conversation whole
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1).join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    rows = rows.select("conv_id", "role", "text", (F.col("_before") + F.col("_at")).alias("place"))
    first = rows.where("place = 0 and role = 'system'").select(F.col("conv_id").alias("_conv"), F.col("text").alias("system"))
    known = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    own = F.floor(F.col("place") / block)
    # the system turn is no history
    last = F.when((F.col("place") > 0) | F.col("system").isNull(), F.floor((F.col("place") + edge) / block)).otherwise(own)
    again = F.sequence(own, last)
    dealt = known.withColumn("block", F.explode(again)).withColumn("past", F.col("block") > own)
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    return dealt.mapInArrow(window_spans(budget, history, source), WINDOW_SCHEMA)


def in_order(windows: DataFrame) -> DataFrame:
    """Windows of a conversation together and in order."""
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return windows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block", "window")


def read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over windows in order: each conversation's turns and targets, read from the text.

    A digest runs over a whole conversation, whose windows so are read by one
    task, one after the other.
    """
    state: dict | None = None
    out: list[dict] = []
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def done(s: dict) -> dict:
        return {k: v.hexdigest() if k.endswith("sha256") else v for k, v in s.items()}

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != state["conv_id"]:
                if state:
                    out.append(done(state))
                state = {"conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}
            text = row["formatted"]
            state["formatted_chars"] += len(text)
            state["n_windows"] += 1
            for k, m in enumerate(_TURN.finditer(text)):
                if k >= row["repeated"]:
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for span in row["loss"]:
                target = unescape(text[span["begin"] : span["end"]])
                state["loss_chars"] += len(target)
                state["loss_sha256"].update(target.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
    if state:
        out.append(done(state))
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings, then read the windows back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    import public_tokenizers

    windows = format_windows(every, vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return in_order(windows).mapInArrow(read_windows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
