from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from data import random_ratings, rows
from ratewright.operators import layout, profile


def test_partition_balance(spark):
    frame = random_ratings(spark, partitions=6)
    assert layout.partition_count(frame) == 6
    balance = layout.partition_balance(frame).collect()
    assert [r.partition_id for r in balance] == list(range(6))
    halves = layout.partition_balance(frame, 2).collect()
    assert len(halves) == 2 and sum(r.num_rows for r in halves) == 3000
    assert max(r.num_rows for r in halves) - min(r.num_rows for r in halves) <= 6


def test_group_partitions_follow_the_shuffle(spark):
    frame = random_ratings(spark)
    placed = layout.group_partitions(frame, "rating", width=3).collect()
    assert {r.rating: r.num_rows for r in placed} == {
        r.rating: r.num_ratings for r in profile.rating_histogram(frame).collect()
    }
    assert {r.partition_id for r in placed} <= {0, 1, 2}


def test_width_report(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    report = layout.shuffle_width_report(random_ratings(spark), ["rating"], (2, 20)).collect()
    assert [(r.shuffle_partitions, r.num_groups, r.num_rows, r.equal) for r in report] == [
        (2, 5, 3000, True),
        (20, 5, 3000, True),
    ]
    assert all(r.elapsed > 0 and not r.adaptive for r in report)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_scoped_conf_restores_after_an_error(spark):
    key, unset = "spark.sql.shuffle.partitions", "spark.ratewright.probe"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), layout.scoped_conf(spark, {key: 3, unset: "x"}):
        assert spark.conf.get(key) == "3"
        raise RuntimeError
    assert spark.conf.get(key) == before and spark.conf.get(unset, None) is None


def test_cached_releases_only_what_it_took(spark):
    mine, theirs = random_ratings(spark), random_ratings(spark, n=50).cache()
    with pytest.raises(RuntimeError), layout.cached(mine, theirs):
        assert mine.is_cached
        raise RuntimeError
    assert not mine.is_cached and theirs.is_cached
    theirs.unpersist()


def test_profile_on_a_known_matrix(spark):
    frame = random_ratings(spark)
    local = rows(frame)
    (row,) = profile.matrix_profile(frame).collect()
    users, items = len({r[0] for r in local}), len({r[1] for r in local})
    assert (row.num_ratings, row.users, row.items) == (3000, users, items)
    assert row.density == 3000 / (users * items) and row.sparsity == 1 - row.density
    assert (row.min_rating, row.max_rating) == (1.0, 5.0)
    (empty,) = profile.matrix_profile(frame.filter(F.lit(False))).collect()
    assert (empty.num_ratings, empty.density) == (0, None)


def test_preview(spark):
    frame = random_ratings(spark)
    assert profile.preview(frame, 3).count() == 3
    assert profile.preview(frame, 2, "timestamp", "user_id").count() == 2
