"""Experiments: repeated runs, block sweep, data-size sweep and cross-validated grid.

Each returns a run log. The driver loops over fits, and every fit is a set of Spark jobs on
cached inputs; only one metrics row per fit comes back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, replace
from functools import partial
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import schema as S
from ratewright.functions.hashing import XXHASH64
from ratewright.operators import split
from ratewright.operators.als import ALSParams, drop_shuffles, fit, release
from ratewright.operators.evaluate import run_once
from ratewright.operators.layout import cached
from ratewright.sources.runlog import run_log_frame

# The axes of the full grid (18 configurations), the
# fractions of the size sweep. One block would put all ratings in one task, so block counts
# start at two.
GRID_RANKS = (5, 10, 20)
GRID_REG_PARAMS = (0.05, 0.1, 0.15)
GRID_MAX_ITERS = (5, 10)
BLOCK_COUNTS = (2, 4, 10, 20)
SIZE_FRACTIONS = (0.25, 0.5, 1.0)

POOL = "spark.scheduler.pool"


def model_name(rank: int, reg_param: float, max_iter: int) -> str:
    return f"r{rank}-l{reg_param}-i{max_iter}"


def config_grid(
    ranks: Sequence[int] = GRID_RANKS,
    reg_params: Sequence[float] = GRID_REG_PARAMS,
    max_iters: Sequence[int] = GRID_MAX_ITERS,
    base: ALSParams = ALSParams(),
) -> dict[str, ALSParams]:
    """Every combination of the axes, by name. Equal names would hide a configuration."""
    combinations = list(product(ranks, reg_params, max_iters))
    grid = {
        model_name(*c): replace(base, rank=c[0], reg_param=c[1], max_iter=c[2])
        for c in combinations
    }
    if len(grid) != len(combinations):
        raise ValueError("two grid configurations have the same name")
    return grid


def named_configs(run_log: DataFrame) -> DataFrame:
    """The distinct configurations of a run log, each with its composed name."""
    name = F.concat(
        F.lit("r"), F.col("rank"), F.lit("-l"), F.col("reg_param"), F.lit("-i"), F.col("max_iter")
    )
    configs = run_log.select("rank", "reg_param", "max_iter").distinct()
    return configs.withColumn("model_name", name)


def name_uniqueness(configs: DataFrame) -> DataFrame:
    """One row: configurations, distinct names, and whether they agree."""
    return configs.agg(
        F.count("*").alias("num_configs"),
        F.count_distinct("model_name").alias("num_names"),
    ).withColumn("names_unique", F.col("num_configs") == F.col("num_names"))


def _materialise(*frames: DataFrame) -> list[int]:
    """Fill the caches so that no fit pays for reading; returns the row counts."""
    return [frame.count() for frame in frames]


def _run_all(
    spark: SparkSession,
    steps: Sequence[Callable[[], dict]],
    parallelism: int,
    costs: Sequence[float] | None = None,
) -> list[dict]:
    """The steps' records in order. Side by side, those of most cost start first, each on its
    own, so that none is left to run alone at the end."""
    if parallelism <= 1 or len(steps) <= 1:
        return [step() for step in steps]
    # Job groups and local properties of the caller carry over to the threads, a copy to each: one
    # wrapper would give all its threads the same properties object. Each fit has a
    # scheduler pool of its own: in a session with FAIR scheduling the fits get equal shares of
    # the executors, where one queue would let the first hold up the others.
    def pooled(number: int, step: Callable[[], dict]) -> dict:
        spark.sparkContext.setLocalProperty(POOL, f"fit-{number}")
        try:
            return step()
        finally:
            spark.sparkContext.setLocalProperty(POOL, None)

    threads = [inheritable_thread_target(spark)(partial(pooled, i, s)) for i, s in enumerate(steps)]
    order = sorted(range(len(steps)), key=lambda i: -costs[i]) if costs else range(len(steps))
    with ThreadPool(min(parallelism, len(steps))) as pool:
        found = pool.map(lambda i: (i, threads[i]()), order, chunksize=1)
    return [record for _, record in sorted(found, key=lambda f: f[0])]


def _warm_up(train: DataFrame, params: ALSParams) -> None:
    """A fit that nothing is kept of."""
    release(fit(train, params))
    drop_shuffles(train.sparkSession)


def repeated_runs(
    train: DataFrame,
    test: DataFrame,
    params: ALSParams = ALSParams(),
    runs: int = 3,
    warmup: bool = True,
    dataset: str | None = None,
    num_cores: int | None = None,
) -> DataFrame:
    """The same fit several times on the current session, after an untimed warm-up fit.

    ``num_cores`` is a label for later speedup reports; by default the session's parallelism.
    """
    spark = train.sparkSession
    cores = spark.sparkContext.defaultParallelism if num_cores is None else num_cores
    with cached(train, test) as (train_rows, test_rows):
        train_count, _ = _materialise(train_rows, test_rows)
        if warmup:
            _warm_up(train_rows, params)
        tags = {"dataset": dataset, "num_cores": cores, "train_count": train_count}
        records = [
            run_once(train_rows, test_rows, params, {**tags, "run": run})
            for run in range(1, runs + 1)
        ]
    return run_log_frame(spark, records)


def block_sweep(
    train: DataFrame,
    test: DataFrame,
    blocks: Sequence[int] = BLOCK_COUNTS,
    runs: int = 3,
    params: ALSParams = ALSParams(),
    dataset: str | None = None,
    parallelism: int = 1,
) -> DataFrame:
    """Equal user and item block counts, each fitted several times.

    A fit of few blocks leaves most of a cluster idle. With ``parallelism`` above one, that many
    fits run at once; their times then affect each other, which ``concurrency`` records.
    """
    spark = train.sparkSession
    plans = [(n, run) for n in blocks for run in range(1, runs + 1)]
    with cached(train, test) as (train_rows, test_rows):
        train_count, _ = _materialise(train_rows, test_rows)
        tags = {
            "dataset": dataset, "train_count": train_count,
            "concurrency": max(1, min(parallelism, len(plans))),
        }
        steps = [
            partial(run_once, train_rows, test_rows, params.with_blocks(n), {**tags, "run": run})
            for n, run in plans
        ]
        records = _run_all(spark, steps, parallelism)
    return run_log_frame(spark, records)


def size_sweep(
    train: DataFrame,
    test: DataFrame,
    fractions: Sequence[float] = SIZE_FRACTIONS,
    runs: int = 3,
    params: ALSParams = ALSParams(),
    warmup: bool = True,
    sample: Callable[[DataFrame, float], DataFrame] = split.hash_sample,
    dataset: str | None = None,
) -> DataFrame:
    """Growing samples of the training set against one uncleaned test set.

    Small samples miss some test users and items, which shows as coverage below one. Pass
    ``split.bernoulli_sample`` for Spark's own sampling.
    """
    spark = train.sparkSession
    records = []
    with cached(train, test) as (train_rows, test_rows):
        _materialise(train_rows, test_rows)
        for fraction in fractions:
            whole = fraction == 1.0
            with cached(train_rows if whole else sample(train_rows, fraction)) as (subset,):
                (num_ratings,) = _materialise(subset)
                if warmup:
                    _warm_up(subset, params)
                tags = {
                    "dataset": dataset,
                    "num_cores": spark.sparkContext.defaultParallelism,
                    "subset_fraction": float(fraction),
                    "train_count": num_ratings,
                }
                records += [
                    run_once(subset, test_rows, params, {**tags, "run": run})
                    for run in range(1, runs + 1)
                ]
    return run_log_frame(spark, records)


def run_key(fold: int, params: ALSParams, dataset: str | None = None) -> str:
    """The name of a fit of a grid, the same in every session."""
    content = json.dumps([dataset, fold, asdict(params)], sort_keys=True)
    return hashlib.sha256(content.encode()).hexdigest()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The records of all fits in a store, each in a directory of its own: fits that end at the
    same time then don't write to one place."""
    return spark.read.schema(S.RUN_LOG).option("recursiveFileLookup", True).parquet(store)


def _unfinished(
    spark: SparkSession, store: str | None, wanted: Mapping[str, str]
) -> dict[str, str]:
    """Of the wanted fits (key to name) those that the stored log does not hold."""
    if store is None:
        return dict(wanted)
    run_log_frame(spark, []).write.mode("overwrite").parquet(f"{store}/fit=none")
    done = read_store(spark, store).select("run_key")
    asked = spark.createDataFrame([(k,) for k in wanted], "run_key string")
    left = {r[0] for r in asked.join(done, "run_key", "left_anti").collect()}
    return {k: name for k, name in wanted.items() if k in left}


def cross_validate(
    folds: Iterable[tuple[int, DataFrame, DataFrame]],
    grid: Mapping[str, ALSParams],
    dataset: str | None = None,
    parallelism: int = 1,
    cache_folds: bool = True,
    store: str | None = None,
) -> DataFrame:
    """Every configuration on every fold: one record per fit.

    ``folds`` yields (number, train, test), for example from ready-made fold files.
    With ``parallelism`` above one, that many fits of a fold run at once. This fills a
    cluster that one fit leaves idle, at the price that the fits' times affect each other;
    their records say so in ``concurrency``.

    ``store`` is a log that every fit is added to when it ends. A grid that was
    stopped and is run again with the same store fits only what is missing there (a fit is
    named by dataset, fold and parameters, so a store is for one state of the data), and
    returns all its records.
    """
    records: list[dict] = []
    spark, keys = None, []
    for number, train, test in folds:
        spark = train.sparkSession
        wanted = {run_key(number, params, dataset): name for name, params in grid.items()}
        keys += wanted
        missing = _unfinished(spark, store, wanted)
        if not missing:
            continue
        with cached(*((train, test) if cache_folds else ())):
            train_count, _ = _materialise(train, test)
            tags = {
                "dataset": dataset, "fold": number, "train_count": train_count,
                "concurrency": max(1, min(parallelism, len(missing))),
            }

            def step(key: str, name: str, train=train, test=test, tags=tags) -> dict:
                record = run_once(train, test, grid[name], {**tags, "model_name": name, "run_key": key})
                if store is not None:
                    one = run_log_frame(spark, [record]).coalesce(1)
                    one.write.mode("overwrite").parquet(f"{store}/fit={key}")
                return record

            steps = [partial(step, key, name) for key, name in missing.items()]
            costs = [grid[name].rank * grid[name].max_iter for name in missing.values()]
            records += _run_all(spark, steps, parallelism, costs)
    if spark is None:
        raise ValueError("no folds given")
    if store is None:
        return run_log_frame(spark, records)
    asked = spark.createDataFrame([(k,) for k in keys], "run_key string")
    stored = read_store(spark, store).join(asked, "run_key", "left_semi")
    return stored.select(*S.RUN_LOG.fieldNames())


def cross_validate_hashed(
    ratings: DataFrame,
    grid: Mapping[str, ALSParams],
    k: int = 5,
    mode: str = XXHASH64,
    dataset: str | None = None,
    parallelism: int = 1,
    store: str | None = None,
) -> DataFrame:
    """Cross-validation over k hash folds of one table.

    The table is cached once with its fold numbers; each fold is a filter on that.
    """
    with cached(split.with_fold(ratings, k, mode)) as (folded,):
        folds = ((number, *split.fold_pair(folded, number)) for number in range(k))
        return cross_validate(folds, grid, dataset, parallelism, cache_folds=False, store=store)
