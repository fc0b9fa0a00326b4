"""Repair of conversation structure by the cheapest edits, decided by whole numbers alone.

A conversation may hold the role initials ``(s?(ua)+)?``. Rows are faulty if they are blank, if
role and text came before in the conversation, or if their last character that is not white
space is none of ``.!?`` (truncated); the first fault counts. Edits: Keep a row (0), Rerole it to
user or assistant (2), Delete it (3; blank and duplicate rows must go), and Insert an empty user
or assistant turn anywhere (2); a truncated row that stays costs 1 more.

States are what may follow: nothing was said yet, the system spoke, the user spoke, the
assistant spoke. An edge takes one row: up to two inserts (three in one gap are never cheapest,
as two of them can go), then K, R or D. Its weight is one big integer. The high digits are the
cost. Below them every row has a slot of three octal digits for its letters, in ASCII order (D, I,
K, R are 1 to 4), filled up with zeros at the end; one more slot is for inserts behind the last
row. A row's letters end with its only K, R or D, so no slot is the beginning of another, and
comparing slots compares audits. So the least integer over all paths has the least cost, and
among those the ASCII-least audit, and it spells that audit.

Rows are numbered within their conversation (``ranking.row_numbers``) and cut into chunks. A task
takes a chunk's least weights from every state to every other; a conversation's chunks are then
joined pairwise, (min, +), neighbours of equal size first. Duplicates are found by a count per
conversation and content. So no conversation has to fit into a task, but for its audit, which is
one value of the result, some 40 bytes a row before that; and a digest of a whole conversation
is read in order by one task, turn by turn.

Defined results: rows are ordered by turn (null first), ties by role and text; null role and text
are one space; a null conversation id is a conversation; repeated rows are duplicates; text is
compared by bytes; an empty table has no rows; conversations without rows after damage have
zeros, an empty audit and no turns; other columns are not read. Turns must fit into 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.operators import ranking
from ratewright.sources import work_path

CHUNK_ROWS = 512
HOT_ROWS = 10_000
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = "DIKR"  # digits 1 to 4
DIGIT_BITS, SLOT_DIGITS = 3, 3
SLOT_BITS = DIGIT_BITS * SLOT_DIGITS

# States, and where an initial leads. The conversation may end in NOTHING and ASSISTANT.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    NOTHING: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
LAST = (NOTHING, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

# Least weights from state to state; a missing pair can't be reached.
Weights = dict[tuple[int, int], int]


class Path(NamedTuple):
    """The weights over some consecutive slots."""

    slots: int
    weights: Weights


def spoken(state: int) -> str:
    """The initial that an inserted or reroled turn has in a state."""
    return "a" if state == USER else "u"


def _slot(letters: str) -> int:
    digits = [LETTERS.index(x) + 1 for x in letters] + [0] * (SLOT_DIGITS - len(letters))
    return sum(d << DIGIT_BITS * (SLOT_DIGITS - 1 - i) for i, d in enumerate(digits))


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """State, cost and letters after no, one and two inserts."""
    cost, letters = 0, ""
    for _ in range(SLOT_DIGITS):
        yield state, cost, letters
        state, cost, letters = NEXT[state][spoken(state)], cost + INSERT, letters + "I"


@cache
def row_edges(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, slot) of a row, the least for each pair of states."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for start in NEXT:
        for state, cost, letters in _inserted(start):
            ways = [(state, cost + DELETE, letters + "D")]
            if not must_go:
                stays = cost + TRUNCATED * truncated
                if initial in NEXT[state]:
                    ways.append((NEXT[state][initial], stays + KEEP, letters + "K"))
                ways.append((NEXT[state][spoken(state)], stays + REROLE, letters + "R"))
            for to, price, spelt in ways:
                found = (price, _slot(spelt))
                best[start, to] = min(best.get((start, to), found), found)
    return tuple((p, q, *least) for (p, q), least in best.items())


def chunk_path(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...]) -> Path:
    """The integer-minimum DP over rows of (initial, must go, truncated)."""
    width = SLOT_BITS * len(rows)
    weights: Weights = {}
    for start in starts:
        least = {start: 0}
        for i, row in enumerate(rows):
            shift = width - SLOT_BITS * (i + 1)
            after: dict[int, int] = {}
            for p, q, cost, slot in row_edges(*row):
                if p in least:
                    weight = least[p] + (cost << width) + (slot << shift)
                    if q not in after or weight < after[q]:
                        after[q] = weight
            least = after
        weights.update(((start, q), w) for q, w in least.items())
    return Path(len(rows), weights)


def closing_path() -> Path:
    """The slot behind the last row: inserts up to an end."""
    weights: Weights = {}
    for start in NEXT:
        for state, cost, letters in _inserted(start):
            if state in LAST:
                weight = (cost << SLOT_BITS) + _slot(letters)
                weights[start, state] = min(weights.get((start, state), weight), weight)
    return Path(1, weights)


def join_paths(first: Path, second: Path) -> Path:
    """The least weights over both, one after the other."""
    a, b = SLOT_BITS * first.slots, SLOT_BITS * second.slots
    low = (1 << b) - 1
    weights: Weights = {}
    for (p, q), x in first.weights.items():
        moved = x << b
        for (r, s), y in second.weights.items():
            if q == r:
                weight = moved + ((y >> b) << a + b) + (y & low)
                if (p, s) not in weights or weight < weights[p, s]:
                    weights[p, s] = weight
    return Path(first.slots + second.slots, weights)


def join_all(paths: Iterator[Path]) -> Path:
    """All paths joined in order, neighbours of about equal size first."""
    stack: list[Path] = []
    for path in paths:
        stack.append(path)
        while len(stack) > 1 and stack[-2].slots <= stack[-1].slots:
            last = stack.pop()
            stack[-1] = join_paths(stack[-1], last)
    while len(stack) > 1:
        last = stack.pop()
        stack[-1] = join_paths(stack[-1], last)
    return stack[0]


def decide(paths: Iterator[Path]) -> tuple[int, str]:
    """Cost and audit of a conversation, from the paths of its chunks."""

    def closed() -> Iterator[Path]:
        yield from paths
        yield closing_path()

    whole = join_all(closed())
    weight = min(w for (start, _), w in whole.weights.items() if start == NOTHING)
    bits = SLOT_BITS * whole.slots
    digits = weight & ((1 << bits) - 1)
    spelt = f"{digits:0{SLOT_DIGITS * whole.slots}o}"
    letters = {ord(str(i)): x for i, x in enumerate(("", *LETTERS))}
    return weight >> bits, spelt.translate(letters)


def replay(audit: str, rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """The repaired turns: the audit's letters applied to the rows in order."""
    state = NOTHING
    for letter in audit:
        if letter == "I":
            role, text = ROLES[spoken(state)], b""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES[spoken(state)]
        state = NEXT[state][role[:1]]
        yield role, text


def number_rows(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``row_num`` in the conversation, stored."""
    spark = rows.sparkSession
    read = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = [F.asc_nulls_first("turn"), "role", "text"]
    placed = ranking.row_numbers(read, ["conv_id"], order, hot_rows).drop(ranking.TOTAL)
    path = work_path(spark, "turns")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def with_faults(numbered: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``row_num``, ``initial``, and ``blank``, ``duplicate`` and
    ``truncated``, of which one at most is true."""
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = said == ""
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    light = numbered.select(
        "conv_id", "turn", "row_num",
        F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"),
        (~blank & ~F.substring(said, -1, 1).isin(*ENDS)).alias("open_end"),
        F.when(~blank, content).alias("content"),
    )
    firsts = (
        light.filter(~F.col("blank"))
        .groupBy(F.col("conv_id").alias("_conv"), F.col("content").alias("_content"))
        .agg(F.min("row_num").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("content") == F.col("_content"))
    duplicate = F.coalesce(F.col("row_num") > F.col("_first"), F.lit(False))
    return light.join(firsts, same, "left").select(
        "conv_id", "turn", "row_num", "initial", "blank",
        duplicate.alias("duplicate"),
        (F.col("open_end") & ~duplicate).alias("truncated"),
    )


_PATH = "chunk bigint, faults array<bigint>, first string, last string, turns array<bigint>, slots bigint, states array<int>, weights array<binary>"
_PATH_KINDS = [
    pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(),
    pa.list_(pa.int32()), pa.list_(pa.binary()),
]
_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_REPORT_KINDS = [pa.int64()] * 6 + [pa.string()]
GROUPS_PER_BATCH = 256


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _chunk_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row per chunk: its counts, its ends, and its path."""
    for (conv_id, chunk), group in groupby(rows, key=lambda r: r[:2]):
        _, _, turns, initials, blank, duplicate, truncated = zip(*group, strict=True)
        faults = [sum(blank), sum(duplicate), sum(truncated), _illegal(list(initials))]
        known = [t for t in turns if t is not None]
        edge = [known[0], known[-1], len(set(known))] if known else []
        must_go = [b or d for b, d in zip(blank, duplicate, strict=True)]
        starts = (NOTHING,) if chunk == 0 else tuple(NEXT)
        path = chunk_path(list(zip(initials, must_go, truncated, strict=True)), starts)
        states = [p * 4 + q for p, q in path.weights]
        weights = [w.to_bytes((w.bit_length() + 7) // 8, "big") for w in path.weights.values()]
        yield conv_id, chunk, faults, initials[0], initials[-1], edge, path.slots, states, weights


def _report_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row per conversation, from its chunks in order."""
    for conv_id, group in groupby(rows, key=lambda r: r[0]):
        faults, distinct = [0, 0, 0, 0], 0
        last_initial, first_turn, last_turn = None, None, None

        def paths() -> Iterator[Path]:
            nonlocal distinct, last_initial, first_turn, last_turn
            for _, _, found, first, last, edge, slots, states, weights in group:
                for i, n in enumerate(found):
                    faults[i] += n
                if last_initial is not None:
                    faults[3] += last_initial + first not in LEGAL
                last_initial = last
                if edge:
                    distinct += edge[2] - (edge[0] == last_turn)
                    first_turn = edge[0] if first_turn is None else first_turn
                    last_turn = edge[1]
                pairs = [divmod(s, 4) for s in states]
                yield Path(slots, {k: int.from_bytes(w, "big") for k, w in zip(pairs, weights, strict=True)})

        cost, audit = decide(paths())
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - distinct
        yield conv_id, gaps, *faults, cost, audit


def audit(numbered: DataFrame) -> DataFrame:
    """Per conversation ``gaps``, the counts of faults, ``illegal``, ``cost`` and ``audit``."""
    kind = numbered.schema["conv_id"].dataType.simpleString()
    arrow = pa.schema([("i", _arrow_kind(numbered))]).field("i").type

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_names(_PATH)]
        yield from _batched(_chunk_rows(_stream(batches)), [arrow, *_PATH_KINDS], names, GROUPS_PER_BATCH)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_names(_REPORT)]
        yield from _batched(_report_rows(_stream(batches)), [arrow, *_REPORT_KINDS], names, GROUPS_PER_BATCH)

    chunk = F.floor((F.col("row_num") - 1) / CHUNK_ROWS)
    faults = with_faults(numbered).withColumn("chunk", chunk)
    return (
        faults.repartition("conv_id", "chunk")
        .sortWithinPartitions("conv_id", "chunk", "row_num")
        .select("conv_id", "chunk", "turn", "initial", "blank", "duplicate", "truncated")
        .mapInArrow(chunks, f"conv_id {kind}, {_PATH}")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk")
        .mapInArrow(reports, f"conv_id {kind}, {_REPORT}")
    )


def _arrow_kind(frame: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema["conv_id"].dataType)


def repaired_turns(numbered: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``role`` and ``text`` (bytes) of the repaired turns. Each
    conversation has one more row with place 0, and its turns follow that in the same partition."""
    kind = numbered.schema["conv_id"].dataType.simpleString()
    arrow = _arrow_kind(numbered)

    def turns(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            head = next(group)
            yield conv_id, 0, None, None
            source = ((role, text) for _, role, text in group)
            for place, (role, text) in enumerate(replay(head[1], source), 1):
                yield conv_id, place, role, text
            for _ in source:  # rows that the audit's end does not need to see
                pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [arrow, pa.int64(), pa.string(), pa.binary()]
        yield from _batched(turns(_stream(batches)), kinds, ["conv_id", "place", "role", "text"], 1000)

    heads = audits.select(
        "conv_id", F.lit(0).cast("bigint").alias("row_num"), F.col("audit").alias("role"), F.lit(None).cast("binary").alias("text")
    )
    rows = numbered.select("conv_id", "row_num", "role", F.col("text").cast("binary").alias("text"))
    return (
        heads.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "row_num")
        .select("conv_id", "role", "text")
        .mapInArrow(run, f"conv_id {kind}, place bigint, role string, text binary")
    )


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of ``role:text`` lines, from ``repaired_turns``."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    arrow = _arrow_kind(turns)

    def lines(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            digest = hashlib.sha256()
            for _, place, role, text in group:
                if place:
                    digest.update((b"\n" if place > 1 else b"") + role.encode() + b":" + text)
            yield conv_id, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(lines(_stream(batches)), [arrow, pa.string()], ["conv_id", "repaired_sha256"], 1000)

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of conversations damaged by a hash of their place: some are dropped, emptied, robbed
    of their ends, repeated, or given to the user. Nulls are one space."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    place = F.concat(shown("conv_id"), F.lit(":"), shown("turn"))
    case = F.crc32(place.cast("binary")) % 20
    text = (
        F.when(case == 1, F.lit("")).when(case == 2, F.translate(shown("text"), ENDS, "")).otherwise(shown("text"))
    )
    role = F.when(case == 4, F.lit("user")).otherwise(shown("role"))
    copies = F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1).cast("int"))
    rows = conversations.filter(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c"))
    return rows.withColumn("_c", F.explode("_c")).drop("_c")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of conversations (see ``audit``, ``repaired_turns``).

    ``ids`` names conversations (``conv_id``, null once) that may have no rows left; they are
    reported with zeros and an empty audit. The report is stored.
    """
    spark = rows.sparkSession
    numbered = number_rows(rows)
    found = audit(numbered)
    if ids is not None:
        known = found.withColumnRenamed("conv_id", "_conv")
        zeros = {n: 0 for n in _names(_REPORT)[:-1]}
        found = (
            ids.select("conv_id").distinct()
            .join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .drop("_conv").fillna(zeros).fillna("", ["audit"])
        )
    path = work_path(spark, "audits")
    found.write.parquet(path)
    report = spark.read.schema(found.schema).parquet(path)
    return report, repaired_turns(numbered, report)
