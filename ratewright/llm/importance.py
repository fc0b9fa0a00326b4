"""Importance resampling towards a target (DSIR): hashed n-gram models and Gumbel top-k.

Words and pairs of words are hashed into ``BUCKETS`` buckets. Two generative models, each one
probability per bucket, are counted: one from target text, one from all raw text. A document's
log weight is the sum of log target - log raw over its n-grams, so exp(log weight) is the ratio
of the two models. Adding an independent Gumbel variable to each log weight and keeping the k
largest draws k documents without replacement in proportion to the ratios (Xie et al., 2023).

Raw counts cover every whole document and are summed per task before the shuffle. Target text
is a bounded sample of labelled documents (``target_docs`` in expectation, chosen by a hash).
The k-th largest key is found by counting: each pass counts the keys in ``BINS`` equal bins and
goes on in the one that holds it, so no rows are sorted or gathered.

Defined results: null, empty and blank texts have no n-grams and log weight 0; without target
text every log weight is 0; equal keys are ordered by a hash of id and text, and rows equal in
that too are repeated rows, which stand or fall together by keeping all that fit in k (so fewer
than k can be kept); null ids are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.text import WordHashes, mix
from ratewright.sources import work_path

BUCKETS = 10_000
TARGET_DOCS = 5000
SMOOTHING = 1.0
SEED = 11
BINS = 4096
# Keys are compared as whole numbers of this fraction.
RESOLUTION = 1 << 20


def _buckets(text: bytes | None, memo: WordHashes) -> np.ndarray:
    words = memo.of((text or b"").lower().split())
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return np.concatenate([mix(words), pairs]) % np.uint64(BUCKETS)


def ngram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = _buckets(text.as_py(), memo).astype(np.int64)
                counts += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "n": counts})

    rows = (
        docs.select(F.col(text_col).cast("binary").alias("t"))
        .mapInArrow(count, "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log target - log raw per bucket, with additive smoothing; 0 without target text."""
    if not target.sum():
        return np.zeros(len(raw))
    smooth = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return smooth(target) - smooth(raw)


def _gumbel(key: Column) -> Column:
    """A Gumbel variable from a hash."""
    unit = (F.shiftrightunsigned(key, 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def weigh(
    docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """``id_col``, ``log_weight``, ``key`` (with its Gumbel variable) and ``tie``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, own = WordHashes(), shared.value
        for batch in batches:
            sums = [
                float(own[_buckets(t.as_py(), memo).astype(np.int64)].sum())
                for t in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sums, pa.float64())],
                names=["id", "tie", "log_weight"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.shiftrightunsigned(
            F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed)), 1
        ).alias("tie"),
        F.col(text_col).cast("binary").alias("t"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, tie bigint, log_weight double")
    key = F.col("log_weight") + _gumbel(F.xxhash64("tie"))
    return out.select(F.col("id").alias(id_col), "log_weight", key.alias("key"), "tie")


def top_k(rows: DataFrame, k: int) -> tuple[int, int]:
    """The least (key, tie), as whole numbers, that belongs to the k largest.

    ``rows`` has ``key`` and ``tie`` as BIGINT, ties not negative. At most BINS counts a pass reach the driver.
    """

    def kth(frame: DataFrame, column: str, k: int) -> tuple[int | None, int]:
        """The k-th largest value, and how many are above it."""
        edges = frame.agg(F.min(column), F.max(column)).first()
        low, high = edges[0], edges[1]
        above = 0
        while low < high:
            step = max(1, -(-(high - low + 1) // BINS))
            bin_of = F.expr(f"({column} - {low}L) div {step}L")
            counts = (
                frame.filter(F.col(column).between(low, high))
                .groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))
                .orderBy(F.desc("bin")).collect()
            )
            for found, n in counts:
                if above + n >= k:
                    low, high = low + found * step, min(high, low + (found + 1) * step - 1)
                    break
                above += n
        return low, above

    key, above = kth(rows, "key", k)
    tied = rows.filter(F.col("key") == key)
    if above + tied.count() <= k:
        return key, 0
    tie, more = kth(tied, "tie", k - above)
    # All rows of the last tie are equal; they are kept if they all fit.
    fits = above + more + tied.filter(F.col("tie") == tie).count() <= k
    return key, tie if fits else tie + 1


def resample(
    docs: DataFrame,
    labels: DataFrame,
    keep: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    target_docs: int = TARGET_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """``id_col``, ``log_weight``, ``key`` and ``selected`` for every row of ``docs``; the
    fraction ``keep`` of all rows is selected. Target text is what ``labels`` marks 1."""
    spark = docs.sparkSession
    good = (
        labels.filter(F.col(label_col) == 1)
        .select(F.col(id_col).alias("target_id")).filter("target_id IS NOT NULL").distinct()
    )
    share = min(1.0, target_docs / max(1, good.count()))
    at = F.pmod(F.xxhash64(F.col("target_id").cast("string"), F.lit(seed)), F.lit(1 << 30))
    chosen = good.filter(at < int(share * (1 << 30)))
    # The ids wanted are a bounded sample, so they can go to every task.
    target = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(
        F.broadcast(chosen), F.col("i") == F.col("target_id"), "left_semi"
    )
    ratios = log_ratios(ngram_counts(target, "t"), ngram_counts(docs, text_col))
    path = work_path(spark, "weights")
    weigh(docs, ratios, id_col, text_col, seed).write.parquet(path)
    weights = spark.read.parquet(path)

    whole = F.floor(F.col("key") * RESOLUTION).cast("bigint")
    ranked = weights.select(whole.alias("key"), "tie")
    k = int(keep * weights.count())
    if k < 1:
        selected = F.lit(False)
    else:
        key, tie = top_k(ranked, k)
        selected = (whole > key) | ((whole == key) & (F.col("tie") >= tie))
    return weights.select(id_col, "log_weight", "key", selected.alias("selected"))
