"""Importance resampling towards a target, its n-grams read through a dictionary automaton.

A text is lower-cased (A-Z) and every byte that is in no word becomes one delimiter. A task
keeps a dictionary of the words it has met again, each between two delimiters in an
Aho-Corasick automaton, with the word's CRC-32 as payload. Scanning texts emits the payloads of
their words in order. The CRC of two words joined by a space follows from the two payloads and
the second word's length alone: the first CRC is shifted by as many zero bytes as the space and
the second word have (a linear map, one table per length) and XORed with the second CRC and with
that of the space, shifted by the second word. No pair of words is ever built as a string.

Words that a scan passes over are not in the dictionary: their payloads are computed where they
occur, in the gaps between matches. Once more were passed over than the dictionary has words,
those seen more than once are added, as far as there is room. A word of more than LONGEST bytes
is no part of the automaton. A full dictionary that passes over most words is begun anew.

A feature's CRC modulo BUCKETS is its bucket. Features are counted over all whole texts, per
task before the shuffle. A bucket's gain is the floored, scaled log ratio of its smoothed shares
in target and raw text; a document's weight is the floored mean of its features' gains, and its
score adds a Gumbel variable from a hash of its id. Documents are drawn by score. Ranks come
from a distributed sort by range (``ranking.numbered``); nothing is sorted in one task.

Defined results: null, empty and wordless texts have no features and weight 0; without target
text the gains compare with equal shares; texts are read as bytes, so any bytes are accepted;
ties go to the smaller id, null ids last (their hash is that of the empty id); repeated rows are
rows of their own and are ranked next to each other; an empty table has no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.text import utf8
from ratewright.operators import ranking
from ratewright.sources import work_path

BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
# Bytes of the longest word in the automaton, and its words when it is full.
LONGEST = 64
MOST_WORDS = 100_000
# Bytes of text scanned together, and of one piece of a long text.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20


def _delimited() -> bytes:
    """The byte table of normalisation: letters in lower case, digits, and bytes of non-ASCII
    characters stay, all else is a space."""
    table = bytearray(b" " * 256)
    for byte in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        table[byte] = byte
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 0x20
    return bytes(table)


_TABLE = _delimited()


def shifted(crc: int, length: int) -> int:
    """What a CRC-32 contributes to that of a text with ``length`` further bytes."""
    zeros = bytes(length)
    return zlib.crc32(zeros, crc) ^ zlib.crc32(zeros)


def _shift_tables() -> np.ndarray:
    """``shifted`` for every length up to LONGEST and a space, and each byte of a CRC, by
    linearity."""
    bits = np.array(
        [[shifted(1 << bit, n) for bit in range(32)] for n in range(LONGEST + 2)], np.uint32
    ).reshape(LONGEST + 2, 4, 8)
    tables = np.zeros((LONGEST + 2, 4, 256), np.uint32)
    for bit in range(8):
        has = np.arange(256) >> bit & 1 == 1
        tables[:, :, has] ^= bits[:, :, bit, None]
    return tables


class Dictionary:
    """The automaton of a task: repeated words with their payloads, growing as texts come."""

    def __init__(self) -> None:
        self._tables = _shift_tables()
        space = zlib.crc32(b" ")
        self._space = np.array([shifted(space, n) for n in range(LONGEST + 1)], np.uint32)
        self._clear()

    def _clear(self) -> None:
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # The last payload is no word's: a missed word points to it.
        self._payloads = np.zeros(1, np.uint32)
        self._forget()

    def _forget(self) -> None:
        self._missed: Counter[bytes] = Counter()
        self._misses = self._scanned = 0

    def _learn(self) -> None:
        """Takes up the words missed more than once since the last call, the most frequent first
        (a node's branches are tried in the order they came). A full dictionary that missed most
        words is begun anew."""
        known = len(self._automaton)
        again = sorted((n, word) for word, n in self._missed.items() if n > 1)[::-1]
        added = [word for _, word in again[: MOST_WORDS - known]]
        for number, word in enumerate(added, known):
            self._automaton.add_word(f" {word.decode('latin-1')} ", number)
        if added:
            self._automaton.make_automaton()
            payloads = np.array([zlib.crc32(word) for word in added], np.uint32)
            self._payloads = np.concatenate([self._payloads[:-1], payloads, self._payloads[-1:]])
        elif known >= MOST_WORDS and self._misses > self._scanned // 2:
            self._clear()
        self._forget()

    def _matches(self, text: bytes) -> np.ndarray:
        """Rows of end and number of the dictionary's words in a text."""
        if not len(self._automaton):
            return np.zeros((0, 2), np.int64)
        found = chain.from_iterable(self._automaton.iter(text.decode("latin-1")))
        return np.fromiter(found, np.int64).reshape(-1, 2)

    def _scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The payloads of all words of a delimited text, and where they start and end."""
        raw = np.frombuffer(text, np.uint8) != 0x20
        starts = np.flatnonzero(raw[1:] & ~raw[:-1]) + 1
        ends = np.flatnonzero(raw[:-1] & ~raw[1:]) + 1
        found = self._matches(text)
        numbers = np.full(len(ends), -1)
        numbers[np.searchsorted(ends, found[:, 0])] = found[:, 1]
        crc = self._payloads[numbers]
        gaps = np.flatnonzero(numbers < 0)
        spans = zip(starts[gaps].tolist(), ends[gaps].tolist(), strict=True)
        words = [text[start:end] for start, end in spans]
        crc[gaps] = [zlib.crc32(word) for word in words]
        if len(self._automaton) < MOST_WORDS:
            self._missed.update(word for word in words if len(word) <= LONGEST)
        self._misses += len(words)
        self._scanned += len(ends)
        return crc, starts, ends

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The payloads and lengths of the words of all texts, and how many words each has."""
        found, places = [], []
        for at, piece in _pieces(texts):
            crc, starts, ends = self._scan(piece)
            found.append((crc, ends - starts))
            places.append(starts + at)
            if self._misses > len(self._automaton):  # learning takes as long as the misses took
                self._learn()
        crc, length = (np.concatenate(parts) for parts in zip(*found, strict=True))
        first = np.cumsum([0, *(len(text) + 1 for text in texts)])  # of each text, its delimiter
        return crc, length, np.diff(np.searchsorted(np.concatenate(places), first))

    def pairs(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of all words but the first, each joined by a space to the word before it."""
        first, behind = crc[:-1], length[1:]
        short = np.minimum(behind, LONGEST)
        pairs = self._space[short] ^ crc[1:]
        for byte in range(4):
            pairs ^= self._tables[short + 1, byte, first >> np.uint32(8 * byte) & np.uint32(255)]
        for i in np.flatnonzero(behind > LONGEST):
            spaced = zlib.crc32(b" ", int(first[i]))
            pairs[i] = shifted(spaced, int(behind[i])) ^ int(crc[i + 1])
        return pairs


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Texts in delimited form, one behind the other, cut at delimiters into pieces, and where
    each piece begins."""
    whole = b" ".join([b"", *texts, b""]).translate(_TABLE)
    at = 0
    while len(whole) - at > PIECE_BYTES:
        cut = whole.find(b" ", at + PIECE_BYTES)
        if cut < 0 or cut == len(whole) - 1:
            break
        yield at, whole[at : cut + 1]
        at = cut
    yield at, whole[at:]


class _Block:
    """Buckets of the words of some texts, and of the pair that each word but the first of all
    ends; ``inner`` says which of these pairs lie in one text."""

    def __init__(self, dictionary: Dictionary, texts: list[bytes]) -> None:
        crc, length, self.words = dictionary.scan(texts)
        self.single = crc % np.uint32(BUCKETS)
        self.pair = dictionary.pairs(crc, length) % np.uint32(BUCKETS)
        starts = (np.cumsum(self.words) - self.words)[self.words > 0]
        self.inner = np.ones(len(self.pair), bool)
        self.inner[starts[1:] - 1] = False

    def counts(self) -> np.ndarray:
        return np.bincount(self.single, minlength=BUCKETS) + np.bincount(
            self.pair[self.inner], minlength=BUCKETS
        )

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text and the sum of their gains."""
        each = gains[self.single]
        each[1:] += gains[self.pair] * self.inner
        upto = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(self.words)
        sums = upto[last] - upto[last - self.words]
        return self.words + np.maximum(self.words - 1, 0), sums


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, some megabytes at a time, and the number of the first."""
    start, texts, size = 0, [], 0
    for i, text in enumerate(column):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size > BLOCK_BYTES:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


def feature_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, counts = Dictionary(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                counts += _Block(dictionary, texts).counts()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": counts[used]})

    found = docs.select(utf8(text_col).alias("t")).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        counts[bucket] = n
    return counts


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) per bucket, both smoothed by one."""
    more, most = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * more) / ((s + 1) * most)))
            for t, s in zip(target.tolist(), raw.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_features`` and ``weight`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary()
        for batch in batches:
            for start, texts in _blocks(batch.column(1)):
                block = _Block(dictionary, texts)
                features, sums = block.sums(shared.value)
                weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
                ids = batch.column(0)[start : start + len(texts)]
                columns = [ids, *map(pa.array, (block.words, features, weight))]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["id", "n_words", "n_features", "weight"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t"))
    found = rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumnRenamed("id", id_col)


def _noise(id_col: str, seed: int) -> Column:
    """A floored, scaled Gumbel variable from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    unit = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = DRAWN_PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` for every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (rounded down) are
    drawn and have a rank from 1; the rank of the others is null. ``target`` has ``text_col``.
    """
    spark = docs.sparkSession
    gains = bucket_gains(feature_counts(target, text_col), feature_counts(docs, text_col))
    path = work_path(spark, "weights")
    weigh(docs, gains, id_col, text_col).write.parquet(path)
    stored = spark.read.parquet(path)
    scored = stored.withColumn("score", F.col("weight") + _noise(id_col, seed))
    eligible = F.col("n_words") >= min_words
    drawn = scored.filter(eligible).count() * percent // 100
    placed = ranking.numbered(
        scored.filter(eligible), [F.desc("score"), F.asc_nulls_last(id_col)], "rank"
    )
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    rest = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("bigint"))
    out = (id_col, "n_features", "weight", "score", "rank")
    return placed.withColumn("rank", rank).select(*out).unionByName(rest.select(*out))
