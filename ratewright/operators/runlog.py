"""Summaries of run logs. A log has one row per fit, so plain group-bys are enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions import ratio

MEAN_TIME = "mean_time"
SPEEDUP = "speedup"
EFFICIENCY = "efficiency"
CONCURRENCY = "concurrency"
# What a core summary averages: column of the log, and name in the summary.
CORE_METRICS = {"training_time": "time", "rmse": "rmse", "coverage": "coverage"}


def _spread(column: str, name: str) -> list[Column]:
    return [F.avg(column).alias(f"mean_{name}"), F.stddev(column).alias(f"std_{name}")]


def _timed_alike(run_log: DataFrame) -> list[str]:
    """Fits that ran side by side are never averaged with fits that ran alone."""
    return [c for c in (CONCURRENCY,) if c in run_log.columns]


def grid_summary(run_log: DataFrame) -> DataFrame:
    """Per configuration: RMSE over the folds and mean time; lowest mean RMSE first. A log that
    has ``concurrency`` is also grouped by that."""
    axes = ["rank", "reg_param", "max_iter", *_timed_alike(run_log)]
    summary = run_log.groupBy(*axes).agg(
        *_spread("rmse", "rmse"),
        F.avg("training_time").alias(MEAN_TIME),
        F.count("*").alias("num_folds"),
    )
    return best_first(summary, "mean_rmse", *axes)


def block_summary(run_log: DataFrame) -> DataFrame:
    """Per pair of block counts (and ``concurrency``): RMSE and time."""
    return run_log.groupBy("num_user_blocks", "num_item_blocks", *_timed_alike(run_log)).agg(
        *_spread("rmse", "rmse"), *_spread("training_time", "time")
    )


def core_summary(run_log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per core count (within ``by``, e.g. dataset): time, RMSE, coverage, number of runs."""
    return run_log.groupBy(*by, "num_cores").agg(
        *_spread("training_time", "time"),
        *_spread("rmse", "rmse"),
        F.avg("coverage").alias("mean_coverage"),
        F.count("*").alias("num_runs"),
    )


def moment_state(
    run_log: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(CORE_METRICS)
) -> DataFrame:
    """The mergeable state of a summary: per group ``num_runs`` and for each metric its count,
    mean and sum of squared deviations from that mean (``n_``, ``avg_``, ``m2_``)."""
    parts = [F.count("*").alias("num_runs")]
    for m in metrics:
        n, value = F.count(m), F.col(m).cast("double")
        parts += [n.alias(f"n_{m}"), F.avg(value).alias(f"avg_{m}"), (F.var_pop(value) * n).alias(f"m2_{m}")]
    return run_log.groupBy(*keys).agg(*parts)


def merge_moments(
    states: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(CORE_METRICS)
) -> DataFrame:
    """One state per group from those of several logs, without the logs.

    Deviations are taken from the mean of all before they are squared and added, which loses no
    digits where the means are large and close.
    """
    group = Window.partitionBy(*keys)
    for m in metrics:
        total = F.sum(F.col(f"n_{m}") * F.col(f"avg_{m}")).over(group)
        states = states.withColumn(f"_{m}", ratio(total, F.sum(f"n_{m}").over(group)))
    parts = [F.sum("num_runs").alias("num_runs")]
    for m in metrics:
        away = F.col(f"avg_{m}") - F.col(f"_{m}")
        parts += [
            F.sum(f"n_{m}").alias(f"n_{m}"),
            F.first(f"_{m}").alias(f"avg_{m}"),
            F.sum(F.col(f"m2_{m}") + F.col(f"n_{m}") * away * away).alias(f"m2_{m}"),
        ]
    return states.groupBy(*keys).agg(*parts)


def core_summary_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``core_summary`` from merged states, grouped by ``by`` and ``num_cores``."""

    def spread(m: str) -> list[Column]:
        n = F.col(f"n_{m}")
        deviation = F.when(n > 1, F.sqrt(F.col(f"m2_{m}") / (n - 1)))
        return [F.col(f"avg_{m}").alias(f"mean_{CORE_METRICS[m]}"), deviation.alias(f"std_{CORE_METRICS[m]}")]

    return states.select(
        *by, "num_cores", *spread("training_time"), *spread("rmse"), spread("coverage")[0], "num_runs"
    )


def size_summary(run_log: DataFrame) -> DataFrame:
    """Per training-set size: time, RMSE and coverage, smallest set first."""
    return (
        run_log.groupBy("subset_fraction", "train_count")
        .agg(
            *_spread("training_time", "time"),
            F.avg("rmse").alias("mean_rmse"),
            F.avg("coverage").alias("mean_coverage"),
        )
        .orderBy("train_count", "subset_fraction")
    )


def with_scaling(
    summary: DataFrame, by: Sequence[str] = (), baseline_cores: int = 1
) -> DataFrame:
    """Add speedup over the baseline core count, and efficiency = speedup / cores.

    The baseline is one value per group: a join on ``by``, or a scalar subquery when there
    are no groups. It is NULL, and so are the results, where the baseline was not measured.
    """
    baseline = summary.filter(F.col("num_cores") == F.lit(baseline_cores))
    if by:
        base = baseline.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(MEAN_TIME).alias("_base"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        joined = summary.join(base, same, "left").drop(*(f"_{c}" for c in by))
        base_time = F.col("_base")
    else:
        joined = summary
        base_time = baseline.select(MEAN_TIME).scalar()
    return (
        joined.withColumn(SPEEDUP, ratio(base_time, F.col(MEAN_TIME)))
        .withColumn(EFFICIENCY, ratio(F.col(SPEEDUP), F.col("num_cores")))
        .drop("_base")
    )


def scaling_report(
    run_log: DataFrame, by: Sequence[str] = (), baseline_cores: int = 1
) -> DataFrame:
    """Core summary with speedup and efficiency, fewest cores first."""
    report = with_scaling(core_summary(run_log, by), by, baseline_cores)
    return report.orderBy(*by, "num_cores")


def best_first(summary: DataFrame, metric: str, *tie_break: str) -> DataFrame:
    """Ascending by a metric such as mean_rmse or mean_time."""
    return summary.orderBy(F.asc(metric), *tie_break)


def run_listing(run_log: DataFrame, *columns: str) -> DataFrame:
    """Selected columns of every run, ordered by cores and run."""
    chosen = columns or ("num_cores", "run", "training_time", "rmse", "coverage")
    return run_log.select(*chosen).orderBy("num_cores", "run")
