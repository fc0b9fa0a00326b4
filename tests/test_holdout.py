from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from data import plan, random_ratings, ratings, rows
from ratewright import schema as S
from ratewright.functions import order_hash
from ratewright.functions.hashing import MD5, XXHASH64
from ratewright.operators import holdout, ranking
from ratewright.operators.layout import scoped_conf


def skewed(spark):
    """One user with a third of the rows, many of them copies of each other."""
    maker = random.Random(5)
    data = [
        (maker.randint(2, 40), maker.randint(0, 9), 3.0, maker.randint(0, 3)) for _ in range(800)
    ]
    data += [(1, 5, 4.0, 9)] * 300 + [(1, i, 2.0, i % 7) for i in range(100)]
    return ratings(spark, data).repartition(5)


@pytest.mark.parametrize("mode", [XXHASH64, MD5])
@pytest.mark.parametrize("hot_rows", [0, 20, 399, 400, 4096])
def test_ranks_by_range_equal_the_window(spark, mode, hot_rows):
    frame = skewed(spark)
    user = Window.partitionBy("user_id")
    order = order_hash(S.RATING_COLUMNS, mode, holdout.SHUFFLE_SALT)
    expected = frame.select(
        "*",
        F.row_number().over(user.orderBy(order, "item_id", "timestamp", "rating")).alias("n"),
        F.count("*").over(user).alias("total"),
    )
    assert rows(holdout.shuffle_rank(frame, mode, hot_rows)) == rows(expected)


def test_building_the_frame_counts_users_and_no_more(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("holdout-plan", "")
    holdout.user_holdout(skewed(spark))
    jobs = tracker.getJobIdsForGroup("holdout-plan")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= 3  # the count's shuffle, its top rows and their sort


def test_ranks_number_each_user_once(spark):
    ranked = holdout.shuffle_rank(random_ratings(spark)).collect()
    per_user = Counter(r.user_id for r in ranked)
    for user, total in per_user.items():
        own = [r for r in ranked if r.user_id == user]
        assert sorted(r.row_num for r in own) == list(range(1, total + 1))
        assert {r.total for r in own} == {total}


def test_rank_ignores_partitioning(spark):
    frame = random_ratings(spark)
    assert rows(holdout.shuffle_rank(frame)) == rows(holdout.shuffle_rank(frame.repartition(9)))


def test_order_is_not_the_input_order(spark):
    ranked = holdout.shuffle_rank(random_ratings(spark, users=1, n=500))
    by_rank = [r.timestamp for r in ranked.orderBy("row_num").collect()]
    assert by_rank != sorted(by_rank)


def test_holdout_takes_the_quota_of_each_user(spark):
    frame = random_ratings(spark)
    held = holdout.user_holdout(frame)
    totals = Counter(r.user_id for r in frame.collect())
    taken = Counter(r.user_id for r in held.filter("held_out").collect())
    assert {u: taken.get(u, 0) for u in totals} == {u: n // 5 for u, n in totals.items()}
    train, validation = holdout.holdout_pair(held)
    assert sorted(rows(train) + rows(validation)) == rows(frame)


def test_user_with_fewer_than_five_ratings_keeps_all(spark):
    frame = ratings(spark, [(1, i, 1.0, i) for i in range(4)])
    assert holdout.user_holdout(frame).filter("held_out").count() == 0


def test_one_full_shuffle_and_one_sort(spark):
    found = plan(holdout.user_holdout(skewed(spark)))
    assert found.count("Exchange hashpartitioning(user_id") == 1 and found.count("Sort [") == 1
    assert "SinglePartition" not in found


def test_a_hot_user_is_spread_over_partitions(spark):
    """Positions of a user with a third of the rows, most of them copies of one row."""
    frame = ratings(spark, [(1, 5, 4.0, 9)] * 3000 + [(u, 1, 1.0, u) for u in range(2, 6000)])
    with scoped_conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        placed = ranking.numbered(frame.repartition(8), [S.USER, S.ITEM])
    files = placed.filter("user_id = 1").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(n for _, n in files) < 2000
    places = [r.position for r in placed.orderBy("position").collect()]
    assert places == list(range(len(places)))
    by_place = placed.orderBy("position").select(S.USER).collect()
    assert [r.user_id for r in by_place] == [1] * 3000 + list(range(2, 6000))


def test_hot_users_take_no_window_and_no_hash_shuffle(spark):
    found = plan(holdout.shuffle_rank(skewed(spark), hot_rows=50))
    assert found.count("Exchange hashpartitioning(user_id") == 2  # the rest, and one row a hot user
    assert "LeftAnti" in found and "BroadcastHashJoin" in found


def test_the_most_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_GROUPS", 3)
    frame = random_ratings(spark)
    assert len(ranking.hot_groups(frame, [S.USER], 0)) == 3
    assert rows(holdout.shuffle_rank(frame, hot_rows=0)) == rows(holdout.shuffle_rank(frame))


def test_null_groups_are_numbered(spark):
    frame = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(3)], "g int, v int")
    for hot_rows in (0, 4, 100):
        found = ranking.row_numbers(frame, ["g"], ["v"], hot_rows).collect()
        assert sorted((r.g or 0, r.v, r.row_num, r.total) for r in found) == [
            *((0, i, i + 1, 5) for i in range(5)), *((1, i, i + 1, 3) for i in range(3))
        ]


def test_keys_beyond_int(spark):
    big = 1 << 40
    frame = ratings(spark, [(big + u, big * 3 + i, 1.0, i) for u in range(3) for i in range(10)])
    held = holdout.user_holdout(frame).collect()
    assert {r.user_id for r in held} == {big, big + 1, big + 2}
    assert sum(r.held_out for r in held) == 6


def test_empty_input(spark):
    assert holdout.user_holdout(ratings(spark, [])).count() == 0


def test_totals(spark):
    frame = random_ratings(spark)
    assert holdout.user_totals(frame).agg(F.sum("total")).first()[0] == 3000
