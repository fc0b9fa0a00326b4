from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from data import random_ratings, rows
from ratewright.functions.hashing import MD5, ORDER_SPACE, XXHASH64, order_hash, row_hash
from ratewright.operators import split

MODES = [XXHASH64, MD5]


@pytest.mark.parametrize("mode", MODES)
def test_split_is_complete_and_disjoint(spark, mode):
    ratings = random_ratings(spark)
    train, test = split.hash_split(ratings, mode)
    assert sorted(rows(train) + rows(test)) == rows(ratings)
    keys = ["user_id", "item_id", "timestamp"]
    assert train.select(keys).intersect(test.select(keys)).count() == 0
    assert 0.07 < test.count() / ratings.count() < 0.13


@pytest.mark.parametrize("mode", MODES)
def test_split_ignores_partitioning_and_order(spark, mode):
    ratings = random_ratings(spark)
    shuffled = ratings.repartition(7).orderBy(F.desc("timestamp"))
    assert rows(split.with_split_bucket(ratings, mode)) == rows(
        split.with_split_bucket(shuffled, mode)
    )


def test_default_bucket_definition(spark):
    ratings = random_ratings(spark)
    wanted = F.pmod(F.xxhash64("user_id", "item_id", "timestamp"), F.lit(10))
    bucketed = split.with_split_bucket(ratings)
    assert bucketed.filter(F.col("split_bucket") != wanted).count() == 0
    assert dict(bucketed.dtypes)["split_bucket"] == "bigint"


def test_labels_match_the_pair(spark):
    ratings = random_ratings(spark)
    labelled = split.with_split_label(ratings)
    train, test = split.hash_split(ratings)
    assert rows(labelled.filter("split = 'train'").drop("split")) == rows(train)
    assert rows(labelled.filter("split = 'test'").drop("split")) == rows(test)


def test_reconciliation(spark):
    ratings = random_ratings(spark)
    (row,) = split.split_reconciliation(ratings, *split.hash_split(ratings)).collect()
    assert row.total_rows == 3000 and row.reconciled


@pytest.mark.parametrize("mode", MODES)
def test_folds_partition_the_rows_and_do_not_follow_the_split(spark, mode):
    train, _ = split.hash_split(random_ratings(spark, n=20000), mode)
    folded = split.with_fold(train, 5, mode)
    sizes = split.fold_sizes(folded).collect()
    total = train.count()
    assert len(sizes) == 5 and sum(r.test_rows for r in sizes) == total
    assert all(r.train_rows + r.test_rows == total for r in sizes)
    # Folds on the split's own hash would leave one fold at half size.
    assert all(0.17 < r.test_rows / total < 0.23 for r in sizes)
    fold_train, fold_test = split.fold_pair(folded, 3)
    assert sorted(rows(fold_train) + rows(fold_test)) == rows(train)


def test_hash_samples_are_nested(spark):
    ratings = random_ratings(spark)
    small, half, full = (split.hash_sample(ratings, f) for f in (0.25, 0.5, 1.0))
    assert set(rows(small)) <= set(rows(half)) and rows(full) == rows(ratings)
    assert split.hash_sample(ratings, 0.0).count() == 0
    with pytest.raises(ValueError):
        split.hash_sample(ratings, 1.5)


def test_bernoulli_sample(spark):
    ratings = random_ratings(spark)
    sample = split.bernoulli_sample(ratings, 0.25)
    assert rows(sample) == rows(split.bernoulli_sample(ratings, 0.25))
    assert 0.2 < sample.count() / 3000 < 0.3
    assert rows(split.bernoulli_sample(ratings, 1.0)) == rows(ratings)


@pytest.mark.parametrize("mode", MODES)
def test_hash_ranges(spark, mode):
    ratings = random_ratings(spark)
    bounds = ratings.agg(F.min(order_hash(["item_id"], mode)), F.max(order_hash(["item_id"], mode)))
    low, high = bounds.first()
    assert 0 <= low < high < ORDER_SPACE
    with pytest.raises(ValueError, match="sha"):
        row_hash(["item_id"], "sha")
