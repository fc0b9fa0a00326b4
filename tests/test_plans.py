"""The plans the operators should get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from data import plan
from ratewright.operators import layout, profile, split
from ratewright.plans import inputs
from ratewright.plans.catalogue import CATALOGUE
from ratewright.sources import read_header_csv, write_parquet

# Fits a model, or runs jobs to build its result: the plan is only that of a small table.
RUNS_FITS = {n for n in CATALOGUE if n.startswith("als_")}


@pytest.mark.parametrize("name", sorted(set(CATALOGUE) - RUNS_FITS))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    found = plan(CATALOGUE[name].query(spark, sf_dir))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in found
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_least_active_users_is_a_top_k(spark, sf_dir):
    found = plan(profile.least_active_users(inputs.basket_ratings(spark, sf_dir)))
    assert "TakeOrderedAndProject" in found and "rangepartitioning" not in found


def test_scan_reads_only_the_columns_in_use(spark, sf_dir):
    found = plan(profile.ratings_per_user(inputs.basket_ratings(spark, sf_dir)))
    assert "ReadSchema: struct<l_orderkey:bigint>" in found


def test_splits_need_no_shuffle(spark, sf_dir):
    ratings = inputs.basket_ratings(spark, sf_dir)
    sample = split.hash_sample(ratings, 0.5)
    for frame in (*split.hash_split(ratings), split.with_fold(ratings), sample):
        assert "Exchange" not in plan(frame)


def test_stored_split_is_pruned_and_key_filter_pushed(spark, sf_dir, tmp_path):
    path = str(tmp_path / "split")
    write_parquet(split.with_split_label(inputs.basket_ratings(spark, sf_dir)), path, "split")
    train = spark.read.parquet(path).filter("split = 'train'")
    found = plan(profile.ratings_of_user(train, 873))
    assert "PartitionFilters: [isnotnull(split" in found
    assert "EqualTo(user_id,873)" in found


def test_csv_source_sees_whole_lines_whatever_is_selected(spark, tmp_path):
    """Pruned columns would hide a line's faults: which rows are ratings must not depend on it."""
    path = tmp_path / "r.csv"
    path.write_text("userId,movieId,rating,timestamp\n1,2,3.0,4\n2,2,3.0,late\n3,2,3.0,4,5\n")
    found = read_header_csv(spark, str(path)).ratings.select("user_id")
    assert [r.user_id for r in found.collect()] == [1]


def test_cold_start_of_a_bucketed_table_takes_two_scans(spark, sf_dir):
    for name in ("clean_test", "coldstart_report"):
        result = CATALOGUE[name].query(spark, sf_dir)
        result.collect()
        final = plan(result).split("== Initial Plan ==")[0]
        assert final.count("FileScan") - final.count("ReusedExchange") <= 2


def test_profile_is_one_scan(spark, sf_dir):
    found = plan(profile.matrix_profile(inputs.basket_ratings(spark, sf_dir)))
    assert found.count("FileScan") == 1


def test_test_only_keys_are_one_scan_and_one_shuffle(spark, sf_dir):
    found = plan(CATALOGUE["test_only_users"].query(spark, sf_dir))
    assert found.count("FileScan") == 1 and found.count("Exchange") == 1


def test_histogram_aggregates_before_the_shuffle(spark, sf_dir):
    frame = inputs.basket_ratings(spark, sf_dir)
    with layout.scoped_conf(spark, {"spark.sql.adaptive.enabled": False}):
        found = plan(frame.groupBy("rating").agg(F.count("*")))
    assert "partial_count" in found.split("Exchange")[1]


def test_epoch_seconds_round_down_in_any_zone(spark):
    """Whole seconds of the wall clock, by calendar fields only before 1970."""
    texts = {"1969-12-31 23:59:59.5": -1, "1969-12-31 00:00:00": -86400, "1900-01-01 00:00:00.25": -2208988800,
             "1970-01-01 00:00:00.75": 0, "2024-03-10 02:30:00": 1710037800, "2262-04-11 23:47:16.9": 9223372036}
    frame = spark.createDataFrame([(t, s) for t, s in texts.items()] + [(None, None)], "t string, s bigint")
    for zone in ("UTC", "America/New_York"):
        with layout.scoped_conf(spark, {"spark.sql.session.timeZone": zone}):
            found = frame.withColumn("c", F.col("t").cast("timestamp_ntz")).withColumn("n", inputs.epoch_seconds("c"))
            assert found.filter("NOT n <=> s").count() == 0
            assert "unix_timestamp" in found._jdf.queryExecution().analyzed().toString()
