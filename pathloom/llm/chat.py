"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Nothing about it is
assumed: successive turn prefixes are rendered, and what one more turn appends to the
output before is that turn's span; where the output before is not a prefix of the new
one, the template rewrote history and the turn is flagged. Where a turn's own text
stands inside its span is found by rendering the last turn with two different probe
texts: the outputs part at the start of the text and meet again at its end.

A conversation is sorted by turn (then role and text, nulls first) and streamed, so a
group is never made of it. With `lookback`, for a template whose output for a turn depends
on no more earlier turns, only these are held; without it, all turns before are.

Null texts and roles are empty; a null conv_id is a conversation of its own; repeated
rows are turns of their own, rows of one turn are ordered by role and text; a text of any length is rendered whole;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

Turn = tuple[str, str]  # role, text

_control = re.compile(r"\\|<(?=/?turn)")
_escaped = re.compile(r"\\(.)", re.S)
_in_role = {"\\": "\\\\", "\n": "\\n", ">": "\\g", "<": "\\l"}
_back = {"\\": "\\", "n": "\n", "g": ">", "l": "<"}


def escape(text: str) -> str:
    """No "<turn" or "</turn" is left in a text; unescape() gives the text back."""
    return _control.sub(lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _back[m[1]], text)


def turn_template(turns: list[Turn]) -> str:
    """<turn ROLE>, a line end, the escaped text, </turn> and a line end for each turn."""
    return "".join(f"<turn {re.sub(r'[\\<>\n]', lambda m: _in_role[m[0]], role)}>\n{escape(text)}</turn>\n" for role, text in turns)


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns that turn_template() was given, from its output alone."""
    at = 0
    while at < len(formatted):
        head = formatted.index(">\n", at)
        end = formatted.index("</turn>\n", head)
        yield unescape(formatted[at + len("<turn ") : head]), unescape(formatted[head + 2 : end])
        at = end + len("</turn>\n")


@dataclass
class Span:
    """Where a turn stands in the output of all turns up to it: from start to end, its text from text_start to text_end."""

    start: int
    end: int
    text_start: int
    text_end: int
    rewrote: bool
    piece: str


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # slices compare fast; halve the range
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: Earlier turns that are enough for turn_template.
LOOKBACK = 4


class Incremental:
    """Spans of the turns of one conversation, one turn after the other."""

    #: Two probe texts without a common first or last character.
    PROBES = ("\ue000", "\ue001")

    def __init__(self, template: Callable[[list[Turn]], str], lookback: int | None):
        """lookback: earlier turns on which the output for a turn can depend; None keeps all of them."""
        self.template, self.lookback = template, lookback
        self.kept: list[Turn] = []
        self.before = template([])
        self.offset = 0  # of the window's output in the whole output

    def add(self, turn: Turn, locate: bool = True) -> Span:
        window = [*self.kept, turn]
        now = self.template(window)
        shared = len(self.before) if now.startswith(self.before) else common_prefix(self.before, now)
        rewrote = shared < len(self.before)
        text_start, text_end = shared, len(now)
        if locate:
            x, y = (self.template([*self.kept, (turn[0], probe)]) for probe in self.PROBES)
            text_start = common_prefix(x, y)
            text_end = len(now) - common_prefix(x[::-1], y[::-1])
        out = Span(self.offset + shared, self.offset + len(now), self.offset + text_start, self.offset + text_end, rewrote, now[shared:])
        if self.lookback is not None and len(window) > self.lookback:
            window = window[len(window) - self.lookback :]
            short = self.template(window)
            self.offset += len(now) - len(short)
            now = short
        self.kept, self.before = window, now
        return out


def format_conversations(
    df: DataFrame, template: Callable[[list[Turn]], str] = turn_template, lookback: int | None = None, loss_role: str = "assistant",
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each turn, in order within a conversation's partition: conv_id, n (from 0), piece (what the
    turn appends to the formatted conversation), start and end of the piece and loss_start and loss_end of the
    text under the loss mask, counted in code points from the conversation's start (null where the turn is
    outside the mask), and rewrote (the template changed what came before). Each turn is rendered after all turns before
    it; give lookback only with a template whose output for a turn depends on no turn further back, like turn_template.
    """
    bounded_batches(df)
    source = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    source = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "t").select("conv_id", "role", "t")
    kind = dict(source.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: object = run  # no conversation yet
        state, n = None, 0
        for batch in slices(batches, "t"):
            rows = []
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "t")), strict=True):
                if held is run or c != held:
                    held, state, n = c, Incremental(template, lookback), 0
                s = state.add((r, t), locate=r == loss_role)
                lost = (s.text_start, s.text_end) if r == loss_role else (None, None)
                rows.append((n, s.piece, s.start, s.end, *lost, s.rewrote))
                n += 1
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, columns, types)], ["conv_id", *FIELDS])

    return source.mapInArrow(run, f"conv_id {kind}, n long, piece string, start long, end long, loss_start long, loss_end long, rewrote boolean")


FIELDS = ("n", "piece", "start", "end", "loss_start", "loss_end", "rewrote")


def read_back(formatted: DataFrame, read: Callable[[str], Iterator[Turn]] = read_turns, unescaped: Callable[[str], str] = unescape) -> DataFrame:
    """Digests of each conversation, taken from the formatted pieces alone, and whether its template rewrote history. formatted is what
    format_conversations() returned, unshuffled: a conversation's pieces follow one another and are hashed as they stream by.
    From where history is rewritten on, pieces no longer make up the conversation, and the digests stop."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: object = run
        turns = loss = hashlib.sha256()
        n = masked = chars = 0
        rewrote = False
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            types = [pa_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True), types)), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrote"])

        pa_kind = None
        for batch in batches:
            pa_kind = batch.column("conv_id").type
            for c, piece, start, end, a, b, changed in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "piece", "start", "end", "loss_start", "loss_end", "rewrote")), strict=True):
                if held is run or c != held:
                    if held is not run:
                        done.append((held, n, turns.hexdigest(), masked, loss.hexdigest(), chars, rewrote))
                    held, turns, loss, n, masked, chars, rewrote = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
                rewrote |= changed
                for r, t in () if rewrote else read(piece):
                    turns.update(f"{r}\n{t}\n".encode())
                    n += 1
                if a is not None and not rewrote:
                    own = unescaped(piece[a - start : b - start])
                    loss.update(own.encode())
                    masked += len(own)
                chars = end
            if done:
                yield out()
                done = []
        if held is not run:
            done = [(held, n, turns.hexdigest(), masked, loss.hexdigest(), chars, rewrote)]
            yield out()

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrote boolean")
