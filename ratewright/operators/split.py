"""Deterministic splits, folds and samples.

All are projections or filters on a content hash: no shuffle, no state, and the same row
goes to the same side whatever the file layout, partitioning or retry history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import schema as S
from ratewright.functions import row_hash
from ratewright.functions.hashing import XXHASH64

BUCKET = "split_bucket"
FOLD = "fold"
SPLIT = "split"

# Ten buckets, the last of which is the test set.
NUM_BUCKETS = 10
TEST_BUCKET = 9

FOLD_SALT = "fold"
SAMPLE_SALT = "sample"
# Fractions are exact to one millionth.
SAMPLE_SLOTS = 1_000_000


def with_split_bucket(
    ratings: DataFrame, mode: str = XXHASH64, num_buckets: int = NUM_BUCKETS
) -> DataFrame:
    """Add ``split_bucket`` in 0..num_buckets-1, taken from user, item and timestamp."""
    bucket = F.pmod(row_hash(S.HASH_COLUMNS, mode), F.lit(num_buckets)).cast("bigint")
    return ratings.withColumn(BUCKET, bucket)


def is_test(test_bucket: int = TEST_BUCKET) -> Column:
    """Predicate on a bucketed frame."""
    return F.col(BUCKET) == F.lit(test_bucket)


def train_rows(bucketed: DataFrame, test_bucket: int = TEST_BUCKET) -> DataFrame:
    return bucketed.filter(~is_test(test_bucket)).drop(BUCKET)


def test_rows(bucketed: DataFrame, test_bucket: int = TEST_BUCKET) -> DataFrame:
    return bucketed.filter(is_test(test_bucket)).drop(BUCKET)


def hash_split(
    ratings: DataFrame,
    mode: str = XXHASH64,
    num_buckets: int = NUM_BUCKETS,
    test_bucket: int = TEST_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """Train and test ratings (9 to 1 with the defaults)."""
    bucketed = with_split_bucket(ratings, mode, num_buckets)
    return train_rows(bucketed, test_bucket), test_rows(bucketed, test_bucket)


def with_split_label(ratings: DataFrame, mode: str = XXHASH64) -> DataFrame:
    """Add ``split`` = 'train' or 'test', for a table stored in one directory per split."""
    label = F.when(is_test(), F.lit("test")).otherwise(F.lit("train"))
    return with_split_bucket(ratings, mode).withColumn(SPLIT, label).drop(BUCKET)


def split_reconciliation(source: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: sizes of the source and of the separated sets, and whether the sets add up to
    the source. Each frame is counted on its own, so a row lost between them shows."""
    counts = [
        frame.select(F.lit(name).alias("part"))
        for name, frame in (("total", source), ("train", train), ("test", test))
    ]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return every.agg(
        *(F.count_if(F.col("part") == p).alias(f"{p}_rows") for p in ("total", "train", "test"))
    ).withColumn(
        "reconciled", F.col("train_rows") + F.col("test_rows") == F.col("total_rows")
    )


def stored_reconciliation(stored: DataFrame, source_rows: int) -> DataFrame:
    """``split_reconciliation`` of a stored table with its ``split`` column, against the rows an
    observation counted on their way into it. One scan; the source is not read again."""
    part = F.col(SPLIT)
    return stored.agg(
        F.lit(source_rows).cast("bigint").alias("total_rows"),
        *(F.count_if(part == p).alias(f"{p}_rows") for p in ("train", "test")),
    ).withColumn(
        "reconciled", F.col("train_rows") + F.col("test_rows") == F.col("total_rows")
    )


def with_fold(ratings: DataFrame, k: int = 5, mode: str = XXHASH64) -> DataFrame:
    """Add ``fold`` in 0..k-1. Independent of the train/test bucket."""
    fold = F.pmod(row_hash(S.HASH_COLUMNS, mode, FOLD_SALT), F.lit(k)).cast("int")
    return ratings.withColumn(FOLD, fold)


def fold_pair(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test ratings of one fold: every other fold, and the fold itself."""
    member = F.col(FOLD) == F.lit(fold)
    return folded.filter(~member).drop(FOLD), folded.filter(member).drop(FOLD)


def fold_sizes(folded: DataFrame) -> DataFrame:
    """Train and test sizes of every fold, from one aggregation over the folds.

    The total comes from a scalar subquery over the per-fold counts, of which there are k.
    """
    counts = folded.groupBy(FOLD).agg(F.count("*").alias("test_rows"))
    total = counts.agg(F.sum("test_rows").alias("n")).scalar()
    return counts.select(FOLD, (total - F.col("test_rows")).alias("train_rows"), "test_rows")


def hash_sample(ratings: DataFrame, fraction: float, mode: str = XXHASH64) -> DataFrame:
    """Keep about ``fraction`` of the rows, always the same ones.

    Samples are nested: the rows kept at 0.25 are among those kept at 0.5.
    """
    _check_fraction(fraction)
    slot = F.pmod(row_hash(S.HASH_COLUMNS, mode, SAMPLE_SALT), F.lit(SAMPLE_SLOTS))
    return ratings.filter(slot < F.lit(round(fraction * SAMPLE_SLOTS)))


def bernoulli_sample(ratings: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own seeded sample. Which rows it keeps depends on the partitioning."""
    _check_fraction(fraction)
    return ratings.sample(withReplacement=False, fraction=fraction, seed=seed)


def _check_fraction(fraction: float) -> None:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be in [0, 1], got {fraction}")
