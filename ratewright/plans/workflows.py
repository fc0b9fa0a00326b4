"""Whole workflows: prepare data, timed training runs, grid search."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright import schema as S
from ratewright.functions.hashing import XXHASH64
from ratewright.operators import coldstart, keybits, profile, runlog, split, sweep
from ratewright.operators.als import ALSParams
from ratewright.sources import (
    ParsedRatings,
    read_bucketed,
    write_bucketed,
    write_json,
    write_parquet,
    write_single_csv,
)
from ratewright.sources.ratings import KEPT, READ, REJECTED

CLEAN = "clean"
# Runs that may be averaged and compared: one dataset, one set of parameters.
RUN_GROUP = [
    "dataset", "rank", "reg_param", "max_iter", "num_user_blocks", "num_item_blocks", "concurrency"
]


def prepare(
    ratings: DataFrame | ParsedRatings, out_dir: str, mode: str = XXHASH64
) -> DataFrame:
    """Split ratings, mark cold-start test rows, store everything, and report.

    Writes ``{out_dir}/ratings``, one directory per split; ``key_bits``, the users and items of
    each split as bitmap words with its counts; ``test``, the test rows with their seen flags,
    one directory per ``clean``; and ``rejected``, rows that are no ratings, as JSON with the file
    and block they came from, if there are any. The source is read once for the ratings, and
    that pass counts the rows it keeps and rejects. Each step reads the stored tables of the one
    before, so a lost executor costs a re-read, not a second parse or a second join.

    The report row holds the cold-start report, the profile of the stored ratings (the splits'
    bitmaps merged), and ``source_rows`` (kept on their way into the split), ``train_rows``,
    ``rejected_rows`` (of parsed ratings) and ``reconciled``: the stored sets add up to the
    source, and what was kept and rejected to what was read.
    """
    parsed = ratings if isinstance(ratings, ParsedRatings) else ParsedRatings(ratings, None)
    spark = parsed.ratings.sparkSession
    out_dir = out_dir.rstrip("/")
    seen = Observation()
    write_parquet(
        split.with_split_label(parsed.observed(seen), mode), f"{out_dir}/ratings", split.SPLIT
    )
    counts = seen.get
    rejected_rows = counts[REJECTED]
    if parsed.source is None and parsed.rejected is not None:
        rejected_rows = parsed.rejected.count()
    if rejected_rows:
        _store_rejected(parsed.rejected, f"{out_dir}/rejected")

    train, test = read_split(spark, out_dir)
    parts = (f.withColumn(split.SPLIT, F.lit(n)) for f, n in ((train, "train"), (test, "test")))
    write_parquet(
        profile.key_bits(next(parts).unionByName(next(parts)), split.SPLIT),
        f"{out_dir}/key_bits", split.SPLIT, "key",
    )
    words = (read_key_words(spark, out_dir, key) for key in (S.USER, S.ITEM))
    flagged = coldstart.flag_seen(test, *words)
    write_parquet(flagged.withColumn(CLEAN, coldstart.is_clean()), f"{out_dir}/test", CLEAN)

    report = coldstart.flag_report(_stored_test(spark, out_dir))
    bits = _key_bits(spark, out_dir)
    whole = profile.profile_of(profile.merge_key_bits(bits))
    own = F.when(F.col(split.SPLIT) == "train", F.col("num_ratings"))
    trained = bits.agg(F.coalesce(F.sum(own), F.lit(0)).cast("bigint").alias("train_rows"))
    kept = F.lit(counts[KEPT]).cast("bigint")
    whole_read = parsed.source is None or counts[KEPT] + counts[REJECTED] == counts[READ]
    return report.select(
        "*",
        *(whole.select(c).scalar().alias(c) for c in whole.columns),
        kept.alias("source_rows"),
        trained.scalar().alias("train_rows"),
        F.lit(rejected_rows).cast("bigint").alias("rejected_rows"),
    ).withColumn(
        "reconciled",
        (F.col("train_rows") + F.col("test_rows") == F.col("source_rows")) & F.lit(whole_read),
    )


def _store_rejected(rejected: DataFrame, path: str) -> None:
    """Kept as text: the columns of a rejected row depend on what is wrong with it."""
    text = rejected.select(F.to_json(F.struct(*rejected.columns)).alias("row"))
    write_parquet(text, path)


def _key_bits(spark: SparkSession, out_dir: str) -> DataFrame:
    kinds = "word BIGINT, bits BIGINT, num_ratings BIGINT, min_rating DOUBLE, max_rating DOUBLE"
    schema = f"{kinds}, {split.SPLIT} STRING, key STRING"
    return spark.read.schema(schema).parquet(f"{out_dir.rstrip('/')}/key_bits")


def read_key_words(
    spark: SparkSession, out_dir: str, key: str, part: str = "train"
) -> DataFrame:
    """The users or items (``key`` is the column's name) of a stored split, as bitmap words."""
    bits = _key_bits(spark, out_dir)
    own = (F.col(split.SPLIT) == part) & (F.col("key") == key)
    return bits.filter(own).select(keybits.WORD, keybits.BITS)


def read_split(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and raw test ratings stored by ``prepare``."""
    schema = T.StructType([*S.RATINGS.fields, T.StructField(split.SPLIT, T.StringType())])
    ratings = spark.read.schema(schema).parquet(f"{out_dir.rstrip('/')}/ratings")
    parts = (ratings.filter(ratings[split.SPLIT] == part) for part in ("train", "test"))
    train, test = (part.drop(split.SPLIT) for part in parts)
    return train, test


def bucket_split(spark: SparkSession, out_dir: str, buckets: int) -> None:
    """Store the split of ``prepare`` once more, train and test bucketed by user, below
    ``{out_dir}/by_user``: cold start, totals and holdouts by user then start co-located."""
    path = f"{out_dir.rstrip('/')}/by_user"
    for part, rows in zip(("train", "test"), read_split(spark, out_dir), strict=True):
        write_bucketed(rows, f"{path}/{part}", S.USER, buckets)
    layout = spark.createDataFrame([(buckets,)], "buckets int")
    write_json(layout.coalesce(1), f"{path}/layout")


def read_bucketed_split(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test ratings stored by ``bucket_split``."""
    path = f"{out_dir.rstrip('/')}/by_user"
    (layout,) = spark.read.schema("buckets int").json(f"{path}/layout").collect()
    train, test = (
        read_bucketed(spark, f"{path}/{part}", S.RATINGS, S.USER, layout.buckets)
        for part in ("train", "test")
    )
    return train, test


def read_clean_test(spark: SparkSession, out_dir: str) -> DataFrame:
    """Test ratings whose user and item training has seen, stored by ``prepare``."""
    return _stored_test(spark, out_dir).filter(CLEAN).select(*S.RATING_COLUMNS)


def _stored_test(spark: SparkSession, out_dir: str) -> DataFrame:
    flags = (coldstart.USER_SEEN, coldstart.ITEM_SEEN, CLEAN)
    schema = T.StructType(
        [*S.RATINGS.fields, *(T.StructField(f, T.BooleanType()) for f in flags)]
    )
    return spark.read.schema(schema).parquet(f"{out_dir.rstrip('/')}/test")


def timed_training(
    train: DataFrame,
    test: DataFrame,
    out_dir: str,
    params: ALSParams = ALSParams(),
    runs: int = 3,
    dataset: str | None = None,
    num_cores: int | None = None,
    earlier_runs: DataFrame | None = None,
) -> DataFrame:
    """Repeated runs on this session, stored with their scaling summary; returns the summary.

    Every session writes its log to a path of its own, ``{out_dir}/runs/session=<id>``, and the
    counts, means and squared deviations of it to ``{out_dir}/moments/session=<id>``. The summary
    merges the moments of all sessions in ``out_dir`` and of ``earlier_runs``: nothing that was
    logged is overwritten or read again. Runs of different datasets or parameters are never averaged together: the
    summary has a group for each, with its own one-core baseline.
    """
    out_dir = out_dir.rstrip("/")
    log = sweep.repeated_runs(train, test, params, runs, True, dataset, num_cores)
    session, keys = uuid.uuid4().hex, [*RUN_GROUP, "num_cores"]
    write_parquet(log, f"{out_dir}/runs/session={session}")
    state = runlog.moment_state(log, keys)
    write_parquet(state, f"{out_dir}/moments/session={session}")
    states = log.sparkSession.read.schema(state.schema).parquet(f"{out_dir}/moments")
    states = states.select(*state.columns)
    if earlier_runs is not None:
        states = states.unionByName(runlog.moment_state(earlier_runs, keys))
    merged = runlog.core_summary_of(runlog.merge_moments(states, keys), RUN_GROUP)
    summary = runlog.with_scaling(merged, RUN_GROUP).orderBy(*keys)
    write_parquet(summary, f"{out_dir}/summary")
    write_single_csv(summary, f"{out_dir}/summary_csv", *RUN_GROUP, "num_cores")
    return summary


def read_runs(spark: SparkSession, out_dir: str) -> DataFrame:
    """The run logs of all sessions that ``timed_training`` stored in ``out_dir``."""
    runs = spark.read.schema(S.RUN_LOG).parquet(f"{out_dir.rstrip('/')}/runs")
    return runs.select(*S.RUN_LOG.fieldNames())


def grid_search(
    folds: Iterable[tuple],
    out_dir: str,
    grid: Mapping[str, ALSParams] | None = None,
    dataset: str | None = None,
    parallelism: int = 1,
) -> DataFrame:
    """Every configuration on every fold, stored as JSON lines; returns the summary.

    Each fit is logged in ``{out_dir}/fits`` when it ends; a search that was stopped goes on from
    there when it is called again.

    ``folds`` are (number, train, test), such as
    ``((n, *read_fold(spark, base, n)) for n in range(1, 6))``, with the rows that are not
    ratings as a fourth member if there are any. Those are stored as ``{out_dir}/rejected``,
    one directory per fold. The default grid has 18 configurations. The summary lists the
    lowest mean RMSE first.
    """

    def accepted() -> Iterator[tuple[int, DataFrame, DataFrame]]:
        for number, train, test, *rejected in folds:
            for rows in rejected:
                _store_rejected(rows, f"{out_dir.rstrip('/')}/rejected/fold={number}")
            yield number, train, test

    log = sweep.cross_validate(
        accepted(), grid or sweep.config_grid(), dataset, parallelism,
        store=f"{out_dir.rstrip('/')}/fits",
    )
    path = f"{out_dir.rstrip('/')}/grid_runs"
    write_json(log, path)
    return runlog.grid_summary(log.sparkSession.read.schema(S.RUN_LOG).json(path))
