"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of a document matches a benchmark item if the whole item can be turned into it with at
most ``rate`` edits per character. Texts are folded first: letters and digits in lower case,
runs of anything else one space.

q-gram lemma: an item of m characters has m - q + 1 q-grams, and each edit destroys at most q of
them, so a match with e edits shares at least m - q + 1 - q * e q-grams with the item, all on
diagonals (document position minus item position) at most e apart. Shared q-grams are counted
per item in bands of 2e + 1 diagonals, one starting at every (e + 1)-th diagonal, so that each
match lies whole in some band. Bands that reach the bound are aligned with the item by a banded
edit distance, and kept if the distance is within the budget. An item of fewer than (e + 1) q
characters has shorter q-grams of its own, as long as it can share one after e edits, and
belongs to an index of that length.

Items that are equal when folded are searched as one. Where a text and an item repeat the same
few words, every q-gram meets every place of the item; the shared q-grams of such texts are
counted item by item and in pieces of ``HITS``, into one count per band.

The benchmark is a query set: it is cut into blocks of at most ``BLOCK_CHARS`` characters, and
each block is sent to the tasks for one pass over all documents. Texts are searched whole, and
no document is shuffled.

Defined results: null and empty texts match nothing; bytes that are not UTF-8 are spaces; null items, and items that are empty when
folded, match nothing; shorter items than a q-gram match where they occur as they are; repeated documents each get their matches; repeated
items match under each of their ids; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.text import mix, readable

Q = 12
RATE = 0.06
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 400_000
# Meetings of a text's q-gram and a place in an item that are counted at a time.
HITS = 1 << 20
_FILTER_BITS = 24
_SPACE = 32
# Types of ids that are returned as they are; others become strings.
_ITEM_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


@cache
def _folding() -> np.ndarray:
    """Code point -> its lower-case letter or digit, or a space."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalnum():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    table[0] = 0  # marks the end of a text
    return table


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after another, a 0 before each, and the place of every character in
    the joined original."""
    joined = "".join("\0" + t.replace("\0", " ") for t in texts)
    codes = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == _SPACE
    kept = np.flatnonzero(~(space & np.concatenate([[False], space[:-1]])))
    return codes[kept], kept


def _qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position on; those over a 0 are hashed like others."""
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for j in range(q):
        value = value * np.uint64(0x9E3779B97F4A7C15) + wide[j : j + n]
    return mix(value)


class Index(NamedTuple):
    """The q-grams of a block of items."""

    q: int
    ids: list[list]  # of each item; equal items are one
    items: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray  # shared q-grams a match must have
    may_hold: np.ndarray  # a bit per value of the low bits of a hash
    hashes: np.ndarray  # sorted, unique
    first: np.ndarray  # where a hash's places start, and behind the last where they end
    item_of: np.ndarray
    place_of: np.ndarray


def _item_codes(text: str | None) -> np.ndarray:
    """An item folded, without space around it."""
    codes, _ = folded([text or ""])
    codes = codes[1:]
    start, end = int(codes[:1].tolist() == [_SPACE]), len(codes) - int(codes[-1:].tolist() == [_SPACE])
    return codes[start:end]


def own_q(length: int, q: int, rate: float) -> int:
    """The longest q-gram, q at most, that a match within the edits of an item must share."""
    return min(q, length // (int(rate * length) + 1))


def build_indexes(rows: list[tuple], q: int = Q, rate: float = RATE) -> list[Index]:
    """Indexes of (id, text) rows, one for each length of q-grams."""
    by_q: dict[int, list[tuple]] = {}
    for row in rows:
        length = len(_item_codes(row[1]))
        if length:
            by_q.setdefault(own_q(length, q, rate), []).append(row)
    return [build_index(own, k, rate) for k, own in sorted(by_q.items())]


def build_index(rows: list[tuple], q: int = Q, rate: float = RATE) -> Index:
    """An index of (id, text) rows."""
    ids, items, number_of = [], [], {}
    for item_id, text in rows:
        codes = _item_codes(text)
        if len(codes) < q:
            continue
        number = number_of.setdefault(codes.tobytes(), len(items))
        if number == len(items):
            ids.append([])
            items.append(codes)
        ids[number].append(item_id)
    lengths = np.array([len(x) for x in items], np.int64)
    # At least one q-gram must be shared, or the lemma says nothing.
    edits = np.minimum((rate * lengths).astype(np.int64), (lengths - q) // q)
    grams = [_qgrams(x, q) for x in items]
    flat = np.concatenate([np.zeros(0, np.uint64), *grams])
    sizes = [len(g) for g in grams]
    item_of = np.repeat(np.arange(len(items)), sizes)
    place_of = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    may_hold = np.zeros(1 << _FILTER_BITS, bool)
    may_hold[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return Index(
        q, ids, items, edits, lengths - q + 1 - q * edits, np.packbits(may_hold), hashes,
        np.append(first, len(flat)), item_of[order], place_of[order].astype(np.int64),
    )


def banded_distance(item: np.ndarray, text: np.ndarray, edits: int, low: int, high: int) -> tuple[int, int, int]:
    """(distance, start, end) of the best match of the whole item in ``text`` on the diagonals
    low..high, widened by the edits; (edits + 1, 0, 0) if none is within the budget."""
    low, high = low - edits, high + edits
    far = len(item) + len(text) + 1
    width = high - low + 1
    steps = np.arange(width)
    place = low + steps  # the text position of each diagonal before row 0
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    begin = place.copy()
    for i, char in enumerate(item):
        at = place + i  # text positions of the row's substitutions
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == char
        change = np.where(inside, cost + ~same, far)  # match or substitute
        skip = np.append(cost[1:] + 1, far)  # drop the item's character
        lower = skip < change
        cost = np.where(lower, skip, change)
        begin = np.where(lower, np.append(begin[1:], 0), begin)
        # Insert characters of the text: cheapest cell to the left plus the distance.
        lead = cost - steps
        best = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == best, steps, 0))
        cost = best + steps
        begin = begin[source]
        beyond = (at + 1 < 0) | (at + 1 > len(text))
        cost[beyond] = far
    k = int(cost.argmin())
    if cost[k] > edits:
        return edits + 1, 0, 0
    return int(cost[k]), int(begin[k]), int(place[k] + len(item))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes add up to ``most`` at most, or of one member."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(at, stop)
        at = stop


def _full_bands(
    index: Index, at: np.ndarray, slot: np.ndarray, owner: np.ndarray, longest: int
) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, band, shared q-grams) of the bands that reach the bound, from the places of
    a text's q-grams in the index."""
    times = index.first[slot + 1] - index.first[slot]
    docs, begins = np.unique(owner, return_index=True)
    hits = np.add.reduceat(times, begins)
    edges = np.append(begins, len(at))
    for run in _pieces(hits, HITS):
        part = slice(int(edges[run.start]), int(edges[run.stop]))
        if run.stop - run.start == 1 and hits[run.start] > HITS:
            doc = int(docs[run.start])
            for found in _full_bands_by_item(index, at[part], slot[part], longest):
                yield doc, *found
            continue
        entry = _spread(index.first[slot[part]], times[part])
        item, place = index.item_of[entry], index.place_of[entry]
        band = (np.repeat(at[part], times[part]) - place + longest) // (index.edits[item] + 1)
        # Width 2e + 1 from every (e + 1)-th diagonal on: a hit is in its own band and, but for the
        # last diagonal of the own stride, in the one before.
        bands = int(band.max()) + 2
        key = (np.repeat(owner[part], times[part]) * len(index.items) + item) * bands + band + 1
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        enough = counts >= index.least[(keys // bands) % len(index.items)]
        for key, count in zip(keys[enough].tolist(), counts[enough].tolist(), strict=True):
            pair, number = divmod(key, bands)
            yield *divmod(pair, len(index.items)), number, count


def _full_bands_by_item(
    index: Index, at: np.ndarray, slot: np.ndarray, longest: int
) -> Iterator[tuple[int, int, int]]:
    """The same for one text, with a count per band of one item at a time."""
    order = np.argsort(slot, kind="stable")
    used, begins = np.unique(slot[order], return_index=True)
    ends = np.append(begins[1:], len(slot))
    sizes = index.first[used + 1] - index.first[used]
    entry, of = _spread(index.first[used], sizes), np.repeat(np.arange(len(used)), sizes)
    by_item = np.argsort(index.item_of[entry], kind="stable")
    entry, of = entry[by_item], of[by_item]
    items, firsts = np.unique(index.item_of[entry], return_index=True)
    for item, first, last in zip(items.tolist(), firsts, np.append(firsts[1:], len(entry)), strict=True):
        stride = int(index.edits[item]) + 1
        base = (int(at.min()) - len(index.items[item]) + longest) // stride
        counts = np.zeros((int(at.max()) + longest) // stride - base + 2, np.int64)
        own, places = of[first:last], index.place_of[entry[first:last]]
        times = ends[own] - begins[own]
        for piece in _pieces(times, HITS):
            here = at[order[_spread(begins[own[piece]], times[piece])]]
            band = (here - np.repeat(places[piece], times[piece]) + longest) // stride - base
            found = np.bincount(band, minlength=len(counts))
            counts += found
            counts[1:] += found[:-1]
        for k in np.flatnonzero(counts >= index.least[item]):
            yield item, int(k) + base, int(counts[k])


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, shared q-grams, distance, start, end): the best match of each item in each
    text, with its place in the original text."""
    codes, original = folded(texts)
    starts = np.flatnonzero(codes == 0)
    hashes = _qgrams(codes, index.q)
    low = (hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)
    maybe = np.flatnonzero(index.may_hold[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
    if not len(maybe) or not len(index.hashes):
        return []
    slot = np.searchsorted(index.hashes, hashes[maybe])
    slot[slot == len(index.hashes)] = 0
    hit = index.hashes[slot] == hashes[maybe]
    maybe, slot = maybe[hit], slot[hit]
    if not len(maybe):
        return []
    owner = np.searchsorted(starts, maybe, side="right") - 1
    longest = max(len(x) for x in index.items)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    ends = np.append(starts[1:], len(codes))
    for doc, i, band, count in _full_bands(index, maybe, slot, owner, longest):
        edits = int(index.edits[i])
        first = (band - 1) * (edits + 1) - longest
        body = slice(int(starts[doc]) + 1, int(ends[doc]))
        # Diagonals relative to a window around the item's place, within the document.
        begin = max(body.start, first - edits)
        end = min(body.stop, first + 3 * edits + 2 + len(index.items[i]))
        if begin >= end or best.get((doc, i), (1,))[0] == 0:
            continue
        distance, a, b = banded_distance(
            index.items[i], codes[begin:end], edits, first - begin, first + 2 * edits + 1 - begin
        )
        if distance <= edits and (distance, -count) < best.get((doc, i), (edits + 1, 0))[:2]:
            base = int(original[starts[doc]]) + 1
            best[doc, i] = (
                distance, -count, int(original[begin + a]) - base,
                int(original[begin + b - 1]) + 1 - base if b > a else int(original[begin + a]) - base,
            )
    return [(d, i, -x[1], x[0], x[2], x[3]) for (d, i), x in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in parts of about ``BLOCK_CHARS`` characters; the driver holds one."""
    rows = benchmark.select(F.col(id_col).alias("id"), readable(F.col(text_col)).alias("text")).filter(
        F.col("text").isNotNull()
    )
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    for k in range(count):
        yield [(r["id"], r["text"]) for r in rows.filter(part == k).orderBy("id", "text").collect()]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    rate: float = RATE,
) -> DataFrame:
    """The columns in ``carry``, ``item`` (its id), ``shared`` (q-grams), ``distance`` (edits), and
    ``start`` and ``end`` in the text, for every item found in every row."""
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    if item_kind not in _ITEM_TYPES:
        benchmark = benchmark.withColumn(item_col, F.col(item_col).cast("string"))
        item_kind = "string"
    inner = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(
        *(F.col(c).alias(n) for c, n in zip(carry, inner, strict=True)),
        readable(F.col(text_col)).alias("t"),
    ).filter(F.length("t") > 0)
    kinds = "".join(f"{n} {t}, " for n, t in rows.dtypes[:-1])
    schema = f"{kinds}item {item_kind}, shared bigint, distance bigint, start bigint, end bigint"
    context = docs.sparkSession.sparkContext
    passes = [
        rows.mapInArrow(
            _search(context.broadcast([tuple(x) for x in build_indexes(block, q, rate)]), item_kind),
            schema,
        )
        for block in blocks(benchmark, item_col, item_text_col)
    ]
    return reduce(DataFrame.unionByName, passes).withColumnsRenamed(
        dict(zip(inner, carry, strict=True))
    )


def without_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    rate: float = RATE,
) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    context = docs.sparkSession.sparkContext
    columns = docs.columns
    rows = docs.select(
        F.struct(*columns).alias("row"), F.coalesce(readable(F.col(text_col)), F.lit("")).alias("t")
    )
    schema = f"row {rows.schema['row'].dataType.simpleString()}, t string"
    for block in blocks(benchmark, item_col, item_text_col):
        indexes = [tuple(x) for x in build_indexes(block, q, rate)]
        if indexes:
            rows = rows.mapInArrow(_drop(context.broadcast(indexes)), schema)
    return rows.select("row.*")


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in turn, in parts of about ``CHUNK_CHARS``, each with the place of its first."""
    held: list[str] = []
    chars = first = 0
    for n, text in enumerate(texts):
        held.append(text.as_py())
        chars += len(held[-1])
        if chars > CHUNK_CHARS or n + 1 == len(texts):
            yield first, held
            held, chars, first = [], 0, n + 1


def _drop(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index(*x) for x in shared.value]
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, texts in _chunks(batch.column(1)):
                for index in indexes:
                    keep[[first + hit[0] for hit in search(index, texts)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _search(shared, item_kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index(*x) for x in shared.value]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found: list[tuple] = []
            for first, held in _chunks(texts):
                for index in indexes:
                    found += [
                        (first + doc, item_id, *rest)
                        for doc, item, *rest in search(index, held)
                        for item_id in index.ids[item]
                    ]
            at, item, *rest = zip(*found, strict=True) if found else [()] * 6
            names = ["item", "shared", "distance", "start", "end"]
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(kept) for c in batch.columns[:-1]),
                    pa.array(item, _ITEM_TYPES[item_kind]),
                    *(pa.array(x, pa.int64()) for x in rest),
                ],
                names=[*batch.schema.names[:-1], *names],
            )

    return run
