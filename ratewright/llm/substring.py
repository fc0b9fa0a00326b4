"""Substring deduplication by seed and extend.

Every document is cut into words. Of each window's 6-word grams, those with the smallest hash
are its anchors (winnowing), so two equal windows share an anchor at the same place. Documents
meet on anchors only:

1. An anchor's *context* is all words of all windows that contain it. Occurrences with equal
   anchor and context (a class) are extended as far as the threshold can ask for: every word of
   the context repeats. A class is counted by a partial aggregation, so thousands of copies of
   one passage are one row per task before the shuffle.
2. Where one anchor has several contexts, one member of each class is extended word by word:
   its windows are hashed, and a window hash that two classes share repeats. Copies never meet
   as pairs.

The words covered by repeated windows are the maximal repeats of at least ``window`` words.
Windows are compared by a 64-bit context or window hash within an equal 64-bit anchor hash.

Defined results: null and empty texts have no words; a text shorter than the window has nothing
to remove; a row that repeats an id and text is one more occurrence, and all its words repeat;
columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.text import WordHashes, document_keys, mix, utf8
from ratewright.sources import work_path

WINDOW = 35
SEED_WORDS = 6

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

ANCHORS = "_id bigint, _th bigint, pos int, h bigint, c bigint"
WINDOWS = "_id bigint, _th bigint, start int, h bigint, w bigint"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Text:
    """The word hashes of one text, its grams and their windows' minima."""

    def __init__(self, hashes: np.ndarray, window: int, seed: int):
        self.n, self.window = len(hashes), window
        grams = np.zeros(self.n - seed + 1, np.uint64)
        for j in range(seed):
            grams = grams * np.uint64(_BASE) + hashes[j : j + len(grams)]
        self.grams = mix(grams)
        self.width = window - seed + 1
        self.lowest = _sliding(self.grams, self.width, np.minimum)  # by window start
        padded = np.concatenate(
            [np.zeros(self.width - 1, np.uint64), self.lowest, np.zeros(self.width - 1, np.uint64)]
        )
        self.anchors = np.flatnonzero(_sliding(padded, self.width, np.maximum) == self.grams)
        spread = mix(hashes + np.uint64(_BASE))
        self.inverse = _powers(_INVERSE, self.n + 1)
        sums = np.cumsum(spread * _powers(_BASE, self.n), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges [lo, hi)."""
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo])

    def context(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return context_range(pos, self.n, self.window, self.window - self.width + 1)

    def contexts(self) -> np.ndarray:
        lo, hi = self.context(self.anchors)
        place = ((self.anchors - lo) * 4096 + (hi - lo)).astype(np.uint64)
        return mix(self.spans(lo, hi) + place * np.uint64(_INVERSE))

    def windows_of(self, pos: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is at one of ``pos``."""
        starts = pos[:, None] + np.arange(1 - self.width, 1)[None, :]
        inside = (starts >= 0) & (starts < len(self.lowest))
        starts = np.where(inside, starts, 0)
        own = inside & (self.lowest[starts] == self.grams[pos][:, None])
        return np.unique(starts[own])


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def context_range(pos, n, window: int, seed: int):
    """Words [lo, hi) of all the windows that contain the gram at ``pos``."""
    return np.maximum(pos - (window - seed), 0), np.minimum(pos + window, n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _rows(ids, ths, lengths, *columns) -> pa.RecordBatch:
    """One row per hit: the document keys repeated, then the columns."""
    arrays = [
        pa.array(np.repeat(np.asarray(ids, np.int64), lengths)),
        pa.array(np.repeat(np.asarray(ths, np.int64), lengths)),
    ]
    for name, parts, dtype in columns:
        whole = np.concatenate(parts) if parts else np.zeros(0, dtype)
        arrays.append(_signed(whole) if dtype == np.uint64 else pa.array(whole.astype(dtype)))
    return pa.RecordBatch.from_arrays(arrays, names=["_id", "_th", *(c[0] for c in columns)])


def _find_anchors(window: int, seed: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, ths, texts = (batch.column(i) for i in range(3))
            ids, ths = ids.to_numpy(), ths.to_numpy()
            kept, pos, h, c = [], [], [], []
            for i in range(batch.num_rows):
                words = texts[i].as_py().split()
                if len(words) < window:
                    continue
                text = _Text(memo.of(words), window, seed)
                kept.append(i)
                pos.append(text.anchors)
                h.append(text.grams[text.anchors])
                c.append(text.contexts())
            yield _rows(
                ids[kept], ths[kept], [len(p) for p in pos],
                ("pos", pos, np.int32), ("h", h, np.uint64), ("c", c, np.uint64),
            )

    return find


def _extend(window: int, seed: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, ths, texts, lists = (batch.column(i) for i in range(4))
            ids, ths = ids.to_numpy(), ths.to_numpy()
            start, h, w = [], [], []
            for i in range(batch.num_rows):
                text = _Text(memo.of(texts[i].as_py().split()), window, seed)
                at = text.windows_of(np.asarray(lists[i].as_py(), np.int64))
                start.append(at)
                h.append(text.lowest[at])
                w.append(text.spans(at, at + window))
            yield _rows(
                ids, ths, [len(s) for s in start],
                ("start", start, np.int32), ("h", h, np.uint64), ("w", w, np.uint64),
            )

    return extend


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    seed_words: int = SEED_WORDS,
) -> DataFrame:
    """Per document (``_id``, ``_th``) the ``spans`` that repeat.

    A span is one BIGINT, first word << 32 | word behind the last. Spans overlap; their union is
    the words to remove. The list of one document is bounded by the number of its words.
    """
    spark = docs.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        # Tables of their own on both sides of a join also let Spark split its hot keys.
        path = work_path(spark, name)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    texts = docs.select(*document_keys(docs, id_col, text_col), utf8(text_col).alias("_text"))
    anchors = stored(texts.mapInArrow(_find_anchors(window, seed_words), ANCHORS), "anchors")
    # Most anchors occur once; they end here.
    seeds = stored(
        anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "seeds"
    )
    anchors = stored(anchors.join(seeds, "h", "left_semi"), "repeated")

    classes = stored(
        anchors.groupBy("h", "c").agg(
            F.count("*").alias("n"),
            # The three come from one row. Any member will do: all have the same context.
            *[F.first(x).alias(x) for x in ("_id", "_th", "pos")],
        ),
        "classes",
    )
    several = classes.groupBy("h").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    members = classes.join(stored(several.select("h"), "several"), "h").select("_id", "_th", "pos")
    ends = members.groupBy("_id", "_th").agg(F.collect_set("pos").alias("at"))
    windows = stored(
        texts.join(ends, ["_id", "_th"])
        .select("_id", "_th", "_text", "at")
        .mapInArrow(_extend(window, seed_words), WINDOWS),
        "windows",
    )
    shared = stored(
        windows.groupBy("h", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "w"),
        "shared",
    )
    by_window = windows.join(shared, ["h", "w"]).select(
        "_id", "_th", _span(F.col("start"), F.col("start") + window)
    )

    copies = classes.filter("n > 1").select("h", "c")
    by_context = anchors.join(copies, ["h", "c"]).select(
        "_id", "_th",
        # The end of the text cuts the range when the words are at hand.
        _span(F.greatest(F.col("pos") - (window - seed_words), F.lit(0)), F.col("pos") + window),
    )
    return (
        by_window.unionByName(by_context)
        .groupBy("_id", "_th")
        .agg(F.collect_set("span").alias("spans"))
    )


def _span(lo, hi):
    return (F.shiftleft(lo.cast("bigint"), 32) + hi).alias("span")


def kept_mask(n: int, spans: list[int] | None) -> np.ndarray:
    """Which of n words are outside all spans."""
    packed = np.asarray(spans or [], np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(packed >> 32, n), 1)
    np.add.at(change, np.minimum(packed & 0xFFFFFFFF, n), -1)
    return np.cumsum(change[:n]) == 0


def cut(text: bytes, keep: np.ndarray) -> bytes:
    """The text without the words that are not kept; runs of kept words stay as they are, and
    one space joins them."""
    if keep.all():
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    return b" ".join(text[places[i][0] : places[j - 1][1]] for i, j in runs)


def _finish(digest: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, out = [], [], []
            for text, spans in zip(batch.column("_text"), batch.column("spans"), strict=True):
                text, spans = text.as_py(), spans.as_py()
                words = text.split()
                keep = kept_mask(len(words), spans)
                counts.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                if digest:
                    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    out.append(cut(text, keep).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                names=["row", "n_words", "n_removed", "kept"],
            )

    return finish


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    seed_words: int = SEED_WORDS,
    digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but for the text), ``n_words``,
    ``n_removed`` and ``kept``, the text without repeated windows. With ``digest``, ``kept`` is
    the SHA-256 in hex of the kept words joined by one space."""
    spans = repeated_spans(docs, id_col, text_col, window, seed_words)
    row = F.struct(*(c for c in docs.columns if c != text_col)).alias("row")
    rows = docs.select(*document_keys(docs, id_col, text_col), utf8(text_col).alias("_text"), row)
    joined = rows.join(spans, ["_id", "_th"], "left").select("row", "_text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _finish(digest), f"row {kind}, n_words bigint, n_removed bigint, kept string"
    )
