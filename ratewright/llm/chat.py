"""Chat formatting with a grammar round trip.

A conversation is the concatenation of its turns, and a turn is

    [INST] text [/INST]      user
    [SYS] text [/SYS]        system
    [BOT] text </s>          assistant
    [ROLE] name [TEXT] text [/ROLE]    any other role, or none

The deterministic parser reads a start marker, takes everything up to the first end marker of
that kind and undoes escapes: a backslash before a backslash, ``[`` or ``<`` stands for that
character, any other backslash for itself. It refuses a text with a bare control string.

A turn is rendered as it is and parsed again. If what comes back is not the one turn that went
in, the control strings in its text get a backslash; if that still does not come back (the text
holds backslashes of its own), every backslash, ``[`` and ``<`` gets one, which always does.
A turn that parses alone parses the same within the concatenation, because its end marker is
found where the turn ends; the conversation query reads the whole output back all the same.

The loss mask marks the text of assistant turns, without markers.

Rows are rendered one by one, without a shuffle. A conversation is read back as a stream: its
rows are sorted within their partition and hashed turn by turn, so a conversation of any length
takes the memory of one turn.

Defined results: null text is empty; bytes that are not UTF-8 are U+FFFD; a null role and an empty one are the empty name; turns are
ordered by turn (null first), ties by role and text; repeated rows are turns of their own; rows
without conversation id form one conversation; an empty table has no rows; columns other than
the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.text import readable

# Start and end markers by role.
MARKERS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[BOT]", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
TEXT = "[TEXT]"
CONTROL = [m for pair in (*MARKERS.values(), OTHER) for m in pair] + [TEXT]

_STARTS = {start: (role, end) for role, (start, end) in MARKERS.items()} | {OTHER[0]: (None, OTHER[1])}
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\([\\\[<])")
_SPECIAL = re.compile(r"[\\\[<]")


class Turn(NamedTuple):
    role: str
    text: str


class Parsed(NamedTuple):
    turn: Turn
    end: int  # position behind the turn
    text_start: int  # the escaped text, for masks
    text_end: int


def _levels(text: str) -> Iterator[str]:
    """The text as it is, then with more and more of it escaped."""
    yield text
    yield _CONTROL.sub(lambda m: "\\" + m[0], text)
    yield _SPECIAL.sub(lambda m: "\\" + m[0], text)


def _assemble(role: str, shown_role: str, text: str) -> tuple[str, int]:
    """The turn's string, and where its text starts."""
    if role in MARKERS:
        start, end = MARKERS[role]
        head = f"{start} "
    else:
        end = OTHER[1]
        head = f"{OTHER[0]} {shown_role} {TEXT} "
    return f"{head}{text} {end}", len(head)


def parse_turn(formatted: str, at: int = 0) -> Parsed:
    """The turn that starts at ``at``; ValueError if none does."""
    for start, (role, end) in _STARTS.items():
        if not formatted.startswith(f"{start} ", at):
            continue
        begin = at + len(start) + 1
        if role is None:
            middle = formatted.find(f" {TEXT} ", begin)
            if middle < 0:
                break
            role = _ESCAPED.sub(r"\1", formatted[begin:middle])
            if role in MARKERS:
                break
            begin = middle + len(TEXT) + 2
        stop = formatted.find(f" {end}", begin)
        if stop < 0:
            break
        shown = formatted[begin:stop]
        if _CONTROL.search(_ESCAPED.sub("", shown)):
            break
        text = _ESCAPED.sub(r"\1", shown)
        return Parsed(Turn(role, text), stop + len(end) + 1, begin, stop)
    raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")


def parse(formatted: str) -> list[Turn]:
    """All turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        parsed = parse_turn(formatted, at)
        turns.append(parsed.turn)
        at = parsed.end
    return turns


def render_turn(role: str | None, text: str | None) -> str:
    """One formatted turn that parses back to exactly this role and text."""
    turn = Turn(role or "", text or "")
    for shown_role, shown in zip(_levels(turn.role), _levels(turn.text), strict=True):
        formatted, _ = _assemble(turn.role, shown_role, shown)
        try:
            parsed = parse_turn(formatted)
        except ValueError:
            continue
        if parsed.turn == turn and parsed.end == len(formatted):
            return formatted
    raise AssertionError("full escaping always parses back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``formatted`` for every row; a
    conversation's output is its ``formatted`` in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            out = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())],
                names=[*batch.schema.names, "formatted"],
            )

    texts = [readable(F.col(name)).alias(name) for name in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *texts)
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, formatted string")


class _Digest:
    """What is read back from one conversation's output, turn by turn."""

    def __init__(self) -> None:
        self.turns = self.loss = self.formatted = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str) -> None:
        self.formatted += len(formatted)
        at = 0
        while at < len(formatted):
            parsed = parse_turn(formatted, at)
            role, text = parsed.turn
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = formatted[parsed.text_start : parsed.text_end]
                unescaped = _ESCAPED.sub(r"\1", masked)
                self.loss += len(unescaped)
                self.loss_hash.update(unescaped.encode())
            at = parsed.end

    def row(self) -> tuple:
        return (self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.formatted)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what a reader recovers from the output: ``conv_id``, ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint,"
        " loss_sha256 string, formatted_chars bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        done: list[tuple] = []
        arrow = None
        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            ids = batch.column("conv_id").to_pylist()
            for conv_id, segment in zip(ids, batch.column("formatted"), strict=True):
                if digest is None or conv_id != current:
                    if digest is not None:
                        done.append((current, *digest.row()))
                    current, digest = conv_id, _Digest()
                digest.read(segment.as_py())
            yield _batch(done, arrow)
            done = []
        if digest is not None:
            yield _batch([(current, *digest.row())], arrow)

    def _batch(rows: list[tuple], arrow) -> pa.RecordBatch:
        kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "formatted")
        .mapInArrow(run, schema)
    )
