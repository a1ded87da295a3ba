"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens give
every span's cost. A window repeats the system turn, then the latest turns before
its first new turn as far as the history budget goes, then takes new turns while
the whole stays within the budget (one new turn at least, however long). The loss
mask covers the texts of new assistant turns: repeated ones are masked, so each
target is learned once.

Template: ``### role: text </turn>`` and a line end for each turn. In roles and
texts the control strings and the backslash are escaped by a backslash, so the
template reads back exactly.

Scale: one shuffle by conversation. Prefix sums are a window function; windows are
formed while the sorted rows stream by, holding the system turn, the history within
its budget and one window, never a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.wavelet import encoder

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "### ", " </turn>\n"
_ESCAPED = re.compile(r"\\(\\|</turn>|### |:)")
_TURN = re.compile(
    r"### ((?:\\(?:\\|</turn>|### |:)|[^\\:])*+): "
    r"((?:[^\\ ]++|\\(?:\\|</turn>|### )| (?!</turn>\n))*+) </turn>\n"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "\\</turn>").replace("### ", "\\### ")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the span of the escaped text, of each turn."""
    return [(unescape(m[1]), unescape(m[2]), *m.span(2)) for m in _TURN.finditer(formatted)]


def turn_tokens(role: Column, text: Column, tokenizer_path: str | None = None) -> Column:
    """Tokens of a formatted turn under a tokenizer; without one, words and single other signs, and three of the template."""
    if tokenizer_path is None:
        return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")), F.lit(0)).cast("long") + 3

    @F.arrow_udf("long")
    def count(roles: pa.Array, texts: pa.Array) -> pa.Array:
        turns = [format_turn(r, t)[0] for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
        return pa.array([len(x) for k in range(0, len(turns), 256) for x in encoder(tokenizer_path).encode(turns[k : k + 256])], pa.int64())

    return count(role, text)


class _Windows:
    """Windows of one conversation, from turns in order."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system = None
        self.past: deque = deque()  # (role, text, prefix sum before it, prefix sum after it)
        self.number = 0
        self.fresh: list = []
        self.context: list = []
        self.count = 0

    def _cost(self, turns: list) -> int:
        return sum(t[3] - t[2] for t in turns)

    def add(self, role: str, text: str, before: int, after: int):
        """The window that this turn closes, if any."""
        turn, done = (role, text, before, after), None
        if self.fresh and self._cost(self.context) + after - self.fresh[0][2] > self.budget:
            done = self.close()
        if not self.fresh:
            room = max(0, min(self.history, self.budget - (after - before) - (self._cost([self.system]) if self.system else 0)))
            near = [t for t in self.past if before - t[2] <= room]
            self.context = ([self.system] if self.system else []) + near
        self.fresh.append(turn)
        self.count += 1
        if self.count == 1 and role == "system":
            self.system = turn
        else:
            self.past.append(turn)
            while self.past and after - self.past[0][2] > self.history:
                self.past.popleft()
        return done

    def close(self):
        parts, spans, size = [], [], 0
        for k, (role, text, *_) in enumerate([*self.context, *self.fresh]):
            part, lo, hi = format_turn(role, text)
            if role == "assistant" and k >= len(self.context):
                spans.append({"begin": size + lo, "end": size + hi})
            parts.append(part)
            size += len(part)
        row = (self.conv, self.number, len(self.context), len(self.fresh), self._cost(self.context) + self.fresh[-1][3] - self.fresh[0][2], "".join(parts), spans)
        self.number += 1
        self.fresh, self.context = [], []
        return row


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_context", pa.int64()), ("n_new", pa.int64()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])
_FLUSH_CHARS = 1 << 20


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FORMATTED)], schema=_FORMATTED)


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer_path: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, n_context, n_new, n_tokens, formatted, loss (character spans).

    budget and history are in tokens of formatted turns under the tokenizer.

    Turns are taken in order of turn, then role, then text (nulls first), so ties
    and repeated rows have a defined place; each is a turn of its own. A null role
    or text is empty. Rows with a null conv_id form one conversation. A system turn
    is repeated only if it is the first turn. Other columns are not read.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("role"), F.col("text"), tokenizer_path))
    order = ["turn", "role", "text"]
    upto = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("after", F.sum("tokens").over(upto)).sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for b in batches:
            for conv, role, text, tokens, after in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Windows(conv, budget, history)
                if (done := now.add(role, text, after - tokens, after)) is not None:
                    out.append(done)
                size += len(text)
                if size > _FLUSH_CHARS and out:
                    yield _batch(out)
                    out, size = [], 0
        if now is not None:
            out.append(now.close())
        if out:
            yield _batch(out)

    schema = "conv_id long, window long, n_context long, n_new long, n_tokens long, formatted string, loss array<struct<begin:long,end:long>>"
    return summed.select("conv_id", "role", "text", "tokens", "after").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from formatted windows, per conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def end():
            conv, turns, all_turns, chars, loss, size, windows = state
            out.append((conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), size, windows))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for conv, context, text, spans in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        end()
                    if len(out) >= 5000:
                        yield batch()
                        out.clear()
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body, *_ in read_turns(text)[context:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    plain = unescape(text[span["begin"] : span["end"]])
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
        if state is not None:
            end()
        yield batch()

    ordered = formatted.select("conv_id", "window", "n_context", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return ordered.select("conv_id", "n_context", "formatted", "loss").mapInArrow(run, schema)
