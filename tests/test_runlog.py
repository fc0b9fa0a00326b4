from __future__ import annotations

import random
import statistics
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame

from ratewright.operators import runlog
from ratewright.sources import run_log_frame

RUNS = st.lists(
    st.tuples(
        st.sampled_from(["a", "b"]),
        st.sampled_from([1, 2, 4]),
        st.floats(0.01, 1e4),
        st.floats(0.1, 5),
    ),
    min_size=1,
    max_size=30,
)


def _log(spark, runs):
    return run_log_frame(
        spark,
        [
            {"dataset": d, "num_cores": c, "training_time": t, "rmse": e, "coverage": 0.5}
            for d, c, t, e in runs
        ],
    )


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(runs=RUNS)
def test_scaling_report_against_plain_statistics(spark, runs):
    found = runlog.scaling_report(_log(spark, runs), ["dataset"]).collect()
    groups: dict[tuple, list] = {}
    for dataset, cores, seconds, error in runs:
        groups.setdefault((dataset, cores), []).append((seconds, error))
    assert [(r.dataset, r.num_cores) for r in found] == sorted(groups)
    for r in found:
        times, errors = zip(*groups[r.dataset, r.num_cores], strict=True)
        assert r.num_runs == len(times)
        assert r.mean_time == pytest.approx(statistics.fmean(times))
        assert r.mean_rmse == pytest.approx(statistics.fmean(errors))
        if len(times) == 1:
            assert r.std_time is None
        else:
            assert r.std_time == pytest.approx(statistics.stdev(times), abs=1e-6)
        if (r.dataset, 1) in groups:
            base = statistics.fmean(t for t, _ in groups[r.dataset, 1])
            assert r.speedup == pytest.approx(base / r.mean_time)
            assert r.efficiency == pytest.approx(base / r.mean_time / r.num_cores)
        else:
            assert r.speedup is None and r.efficiency is None


def test_baseline_without_groups(spark):
    log = _log(spark, [("a", 1, 8.0, 1.0), ("a", 1, 4.0, 1.0), ("a", 4, 2.0, 1.0)])
    one, four = runlog.scaling_report(log).collect()
    assert (one.speedup, one.efficiency) == (1.0, 1.0)
    assert (four.speedup, four.efficiency) == (3.0, 0.75)


def test_missing_baseline_and_zero_time(spark):
    (row,) = runlog.scaling_report(_log(spark, [("a", 2, 1.0, 1.0)])).collect()
    assert row.speedup is None and row.efficiency is None
    rows = runlog.scaling_report(_log(spark, [("a", 1, 1.0, 1.0), ("a", 2, 0.0, 1.0)])).collect()
    assert rows[1].speedup is None


def test_listing_and_best_first(spark):
    log = run_log_frame(
        spark,
        [{"num_cores": c, "run": r, "rmse": 1 / (c + r)} for c in (2, 1) for r in (2, 1)],
    )
    listed = runlog.run_listing(log, "num_cores", "run")
    assert [tuple(r) for r in listed.collect()] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert runlog.best_first(log, "rmse").first().num_cores == 2


def test_merged_moments_equal_the_summary_of_all_runs(spark):
    """Sessions of different sizes, means far from 0, groups with one run, and missing values."""
    maker = random.Random(3)
    rows = [
        (f"d{i % 3}", 1 + i % 2, 1e6 + maker.random(), None if i % 5 == 0 else maker.random(), maker.random(), i % 7)
        for i in range(200)
    ] + [("lone", 1, 5.0, 0.5, 1.0, 0)]
    names = "dataset string, num_cores int, training_time double, rmse double, coverage double, session int"
    log = spark.createDataFrame(rows, names)
    keys = ["dataset", "num_cores"]
    states = [runlog.moment_state(log.filter(f"session = {s}"), keys) for s in range(7)]
    merged = runlog.core_summary_of(runlog.merge_moments(reduce(DataFrame.unionByName, states), keys), ["dataset"])
    want = runlog.core_summary(log, ["dataset"])
    assert merged.columns == want.columns
    found, expected = ({(r.dataset, r.num_cores): r for r in f.collect()} for f in (merged, want))
    assert found.keys() == expected.keys()
    for group, row in expected.items():
        for a, b in zip(found[group], row, strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9)
    again = runlog.merge_moments(runlog.merge_moments(states[0].unionByName(states[1]), keys), keys)
    assert again.count() == runlog.merge_moments(states[0].unionByName(states[1]), keys).count()
