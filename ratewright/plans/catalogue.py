"""Registered queries, each with the SQL that must give the same rows.

Averages and ratios are rounded to six places on both sides. Queries that train models, sample
or depend on physical partitions return the properties that SQL can state: the factors solve
their equations, a prediction is the product of its factors, a group is where its key hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright import schema as S
from ratewright.functions.hashing import MD5, XXHASH64
from ratewright.operators import (
    als,
    coldstart,
    evaluate,
    holdout,
    ids,
    layout,
    profile,
    runlog,
    split,
    sweep,
)
from ratewright.plans import workflows
from ratewright.plans.inputs import basket_ratings, event_run_log, order_ratings, table
from ratewright.sources import (
    checkpoint_folder,
    read_double_colon,
    read_folds,
    read_header_csv,
    read_parquet,
    read_tab,
    work_path,
    write_json,
    write_parquet,
    write_single_csv,
)
from ratewright.sources.ratings import USABLE

# The user of the query that lists one user's ratings: any that every scale holds.
ONE_USER = 101

Query = Callable[[SparkSession, str], DataFrame]

# The same inputs in SQL.
ORDER_RATINGS_SQL = """
    SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(l_partkey AS BIGINT) AS item_id,
           1 + floor((l_quantity - 1) / 10) AS rating,
           CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
BASKET_RATINGS_SQL = """
    SELECT CAST(l_orderkey AS BIGINT) AS user_id,
           CAST(l_partkey * 8 + l_linenumber AS BIGINT) AS item_id,
           1 + floor((l_quantity - 1) / 10) AS rating,
           CAST(epoch(l_shipdate) AS BIGINT) AS "timestamp"
    FROM lineitem"""
RUN_LOG_SQL = """
    SELECT CASE event_id % 2 WHEN 0 THEN 'first' ELSE 'second' END AS dataset,
           'ALS' AS algorithm,
           CAST(1 + event_id % 5 AS INTEGER) AS fold,
           CAST(1 + event_id % 3 AS INTEGER) AS run,
           CAST(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS INTEGER) AS num_cores,
           CAST(CASE user_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1 END AS DOUBLE)
               AS subset_fraction,
           CAST(CASE user_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2000 ELSE 4000 END AS BIGINT)
               AS train_count,
           value + 1 AS training_time,
           CAST(0.8 AS DOUBLE) + (event_id % 100) / CAST(1000 AS DOUBLE) AS rmse,
           1 - (event_id % 10) / CAST(100 AS DOUBLE) AS coverage,
           CAST(CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END AS INTEGER) AS rank,
           CAST(CASE (event_id // 3) % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.1 ELSE 0.15 END
               AS DOUBLE) AS reg_param,
           CAST(CASE (event_id // 9) % 2 WHEN 0 THEN 5 ELSE 10 END AS INTEGER) AS max_iter,
           CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 10 END
               AS INTEGER) AS num_user_blocks,
           CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 10 END
               AS INTEGER) AS num_item_blocks
    FROM events"""


def _md5_sql(columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {columns})), 1, 8) AS BIGINT)"


def _xxhash_bucket_sql(source: str, keys: list[str]) -> str:
    """A SELECT that adds ``split_bucket`` = pmod(xxhash64(keys), 10) to ``source``.

    The published XXH64 steps for 8-byte values, chained from seed 42, in 128-bit arithmetic
    modulo 2^64. Keys must not be negative.
    """
    # The five XXH64 primes.
    p1, p2, p3 = 11400714785074694791, 14029467366897019727, 1609587929392839161
    p4, p5 = 9650029242287828579, 2870177450012600261
    wrap = 1 << 64

    def times(value: str, by: int) -> str:
        return f"(({value}) * {by}::UHUGEINT) % {wrap}"

    def rotated(value: str, left: int) -> str:
        return f"(({value}) * {1 << left} % {wrap} + ({value}) // {1 << (64 - left)})"

    def folded(right: int) -> str:
        return f"xor(h, h // {1 << right})"

    steps = ["42::UHUGEINT"]
    for key in keys:
        word = times(rotated(times(f"CAST({key} AS UHUGEINT)", p2), 31), p1)
        steps += [
            f"xor((h + {p5 + 8}) % {wrap}, {word})",
            f"({times(rotated('h', 27), p1)} + {p4}) % {wrap}",
            times(folded(33), p2),
            times(folded(29), p3),
            folded(32),
        ]
    query = f"SELECT *, {steps[0]} AS h FROM {source}"
    for step in steps[1:]:
        query = f"SELECT * REPLACE ({step} AS h) FROM ({query})"
    # As a signed value the upper half is h - 2^64, and -2^64 is 4 modulo 10.
    bucket = f"CASE WHEN h < {1 << 63} THEN h % 10 ELSE (h + 4) % 10 END"
    return f"SELECT * EXCLUDE (h), CAST({bucket} AS BIGINT) AS split_bucket FROM ({query})"


_KEY_SQL = 'user_id, item_id, "timestamp"'
_XXHASH_KEYS = ["user_id", "item_id", '"timestamp"']
_BUCKET_SQL = f"{_md5_sql(_KEY_SQL)} % 10"
_FOLD_SQL = f"CAST({_md5_sql(_KEY_SQL + ", 'fold'")} % 5 AS INTEGER)"
_SAMPLE_SQL = f"{_md5_sql(_KEY_SQL + ", 'sample'")} % 1000000"
_ORDER_SQL = _md5_sql("user_id, item_id, rating, \"timestamp\", 'holdout'")
_RATING_COLUMNS_SQL = 'user_id, item_id, rating, "timestamp"'

_WITH_ORDERS = f"WITH r AS ({ORDER_RATINGS_SQL})"
_WITH_LOG = f"WITH r AS ({RUN_LOG_SQL})"
_WITH_SPLIT = f"""WITH r AS ({BASKET_RATINGS_SQL}),
    train AS (SELECT * FROM r WHERE {_BUCKET_SQL} <> 9),
    test AS (SELECT * FROM r WHERE {_BUCKET_SQL} = 9)"""
_ALL_ORDERS = f"{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL} FROM r"
_USER_SEEN_SQL = "user_id IN (SELECT user_id FROM train)"
_ITEM_SEEN_SQL = "item_id IN (SELECT item_id FROM train)"
_RANKED_SQL = f"""{_WITH_ORDERS},
    ranked AS (
        SELECT {_RATING_COLUMNS_SQL},
               row_number() OVER (PARTITION BY user_id
                   ORDER BY {_ORDER_SQL}, item_id, "timestamp", rating) AS row_num,
               count(*) OVER (PARTITION BY user_id) AS total
        FROM r),
    quota AS (
        SELECT *, CAST(floor(total * CAST(0.2 AS DOUBLE)) AS BIGINT) AS val_count FROM ranked)"""


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        CATALOGUE[query.__name__] = Entry(query, sql)
        return query

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the DOUBLE columns; Spark keeps the sort order of the input."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.round(name, places) for name in doubles})


def _baskets(
    spark: SparkSession, sf_dir: str, mode: str = MD5
) -> tuple[DataFrame, DataFrame]:
    return split.hash_split(basket_ratings(spark, sf_dir), mode)


# --- Profile ---------------------------------------------------------------------------


@_register(_ALL_ORDERS)
def ratings_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_ratings(spark, sf_dir)


@_register(f"{_WITH_ORDERS} SELECT DISTINCT rating FROM r ORDER BY rating")
def rating_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rating_values(order_ratings(spark, sf_dir))


@_register(f"{_WITH_ORDERS} SELECT rating, count(*) AS num_ratings FROM r GROUP BY rating")
def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rating_histogram(order_ratings(spark, sf_dir))


@_register(
    f"""{_WITH_ORDERS},
    sizes AS (
        SELECT count(*) AS num_ratings, count(DISTINCT user_id) AS users,
               count(DISTINCT item_id) AS items, min(rating) AS min_rating,
               max(rating) AS max_rating
        FROM r)
    SELECT *, round(num_ratings / (CAST(users AS DOUBLE) * items), 6) AS density,
           round(1 - num_ratings / (CAST(users AS DOUBLE) * items), 6) AS sparsity
    FROM sizes"""
)
def matrix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.matrix_profile(order_ratings(spark, sf_dir)))


@_register(f"{_WITH_ORDERS} SELECT user_id, count(*) AS num_ratings FROM r GROUP BY user_id")
def ratings_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ratings_per_user(order_ratings(spark, sf_dir))


@_register(
    f"""{_WITH_ORDERS} SELECT user_id, count(*) AS num_ratings FROM r GROUP BY user_id
    ORDER BY num_ratings, user_id LIMIT 5"""
)
def least_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.least_active_users(order_ratings(spark, sf_dir))


@_register(
    f"""{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL} FROM r
    ORDER BY user_id, item_id, "timestamp", rating LIMIT 5"""
)
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (S.USER, S.ITEM, S.TIMESTAMP, S.RATING)
    return profile.preview(order_ratings(spark, sf_dir), 5, *order)


@_register(f"{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL} FROM r WHERE user_id = {ONE_USER}")
def one_user_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ratings_of_user(order_ratings(spark, sf_dir), ONE_USER)


# --- Splits, folds, samples ------------------------------------------------------------


@_register(
    f"{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL}, {_BUCKET_SQL} AS split_bucket FROM r"
)
def split_bucket_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_split_bucket(order_ratings(spark, sf_dir), MD5)


@_register(
    f"""{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL},
    CASE WHEN {_BUCKET_SQL} = 9 THEN 'test' ELSE 'train' END AS split FROM r"""
)
def hash_split_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split.hash_split(order_ratings(spark, sf_dir), MD5)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


@_register(
    f"""{_WITH_ORDERS}, b AS ({_xxhash_bucket_sql("r", _XXHASH_KEYS)})
    SELECT {_RATING_COLUMNS_SQL},
           CASE WHEN split_bucket = 9 THEN 'test' ELSE 'train' END AS split FROM b"""
)
def hash_split_xxhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_split_label(order_ratings(spark, sf_dir), XXHASH64)


@_register(
    f"""{_WITH_ORDERS} SELECT count(*) AS total_rows,
    count(*) FILTER (WHERE {_BUCKET_SQL} <> 9) AS train_rows,
    count(*) FILTER (WHERE {_BUCKET_SQL} = 9) AS test_rows, true AS reconciled FROM r"""
)
def split_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sets of a split, against the source counted on its way into them."""
    seen, path = Observation(), work_path(spark, "split")
    source = order_ratings(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
    write_parquet(split.with_split_label(source, MD5), path, split.SPLIT)
    return split.stored_reconciliation(spark.read.parquet(path), seen.get["rows"])


@_register(f"{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL}, {_FOLD_SQL} AS fold FROM r")
def kfold_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_fold(order_ratings(spark, sf_dir), 5, MD5)


@_register(
    f"""{_WITH_ORDERS}, n AS (SELECT count(*) AS total FROM r)
    SELECT {_FOLD_SQL} AS fold, any_value(total) - count(*) AS train_rows,
           count(*) AS test_rows
    FROM r, n GROUP BY 1"""
)
def kfold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.fold_sizes(split.with_fold(order_ratings(spark, sf_dir), 5, MD5))


@_register(f"{_WITH_ORDERS} SELECT {_RATING_COLUMNS_SQL} FROM r WHERE {_SAMPLE_SQL} < 250000")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.hash_sample(order_ratings(spark, sf_dir), 0.25, MD5)


@_register(
    f"""{_WITH_ORDERS} SELECT count(*) AS source_rows, CAST(0 AS BIGINT) AS foreign_rows,
    true AS near_fraction FROM r"""
)
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own sample: rows it holds more often than the source, and its size."""
    source = order_ratings(spark, sf_dir)
    kept = split.bernoulli_sample(source, 0.25)
    both = source.select("*", F.lit(0).alias("kept")).unionByName(
        kept.select("*", F.lit(1).alias("kept"))
    )
    rows = both.groupBy(*S.RATING_COLUMNS).agg(
        F.count_if(F.col("kept") == 0).alias("n"), F.count_if(F.col("kept") == 1).alias("k")
    )
    share = F.sum("k") / F.sum("n")
    return rows.agg(
        F.sum("n").alias("source_rows"),
        F.sum(F.greatest(F.col("k") - F.col("n"), F.lit(0))).alias("foreign_rows"),
        share.between(0.2, 0.3).alias("near_fraction"),
    )


# --- Per-user holdout ------------------------------------------------------------------


@_register(f"{_RANKED_SQL} SELECT {_RATING_COLUMNS_SQL}, row_num, total FROM ranked")
def user_shuffle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.shuffle_rank(order_ratings(spark, sf_dir), MD5)


@_register(f"{_WITH_ORDERS} SELECT user_id, count(*) AS total FROM r GROUP BY user_id")
def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.user_totals(order_ratings(spark, sf_dir))


@_register(f"{_RANKED_SQL} SELECT *, row_num <= val_count AS held_out FROM quota")
def user_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.user_holdout(order_ratings(spark, sf_dir), 0.2, MD5)


@_register(f"{_RANKED_SQL} SELECT *, row_num <= val_count AS held_out FROM quota")
def user_holdout_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same holdout where every user beyond 30 ratings is ranked by range."""
    return holdout.user_holdout(order_ratings(spark, sf_dir), 0.2, MD5, hot_rows=30)


# --- Cold start ------------------------------------------------------------------------


@_register(
    f"{_WITH_SPLIT} SELECT DISTINCT user_id FROM test WHERE NOT {_USER_SEEN_SQL}"
)
def unseen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coldstart.unseen_users(*_baskets(spark, sf_dir))


@_register(
    f"{_WITH_SPLIT} SELECT DISTINCT item_id FROM test WHERE NOT {_ITEM_SEEN_SQL}"
)
def unseen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coldstart.unseen_items(*_baskets(spark, sf_dir))


@_register(f"{_WITH_SPLIT} SELECT DISTINCT user_id FROM test WHERE NOT {_USER_SEEN_SQL}")
def test_only_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed = split.with_split_bucket(basket_ratings(spark, sf_dir), MD5)
    return coldstart.test_only_keys(bucketed, S.USER)


@_register(f"{_WITH_SPLIT} SELECT DISTINCT item_id FROM test WHERE NOT {_ITEM_SEEN_SQL}")
def test_only_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed = split.with_split_bucket(basket_ratings(spark, sf_dir), MD5)
    return coldstart.test_only_keys(bucketed, S.ITEM)


@_register(
    f"{_WITH_SPLIT} SELECT {_RATING_COLUMNS_SQL} FROM test WHERE NOT {_ITEM_SEEN_SQL}"
)
def absent_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coldstart.unseen_item_rows(*_baskets(spark, sf_dir))


@_register(
    f"""{_WITH_SPLIT} SELECT item_id, count(*) AS num_ratings FROM test
    WHERE NOT {_ITEM_SEEN_SQL} GROUP BY item_id"""
)
def absent_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coldstart.unseen_item_row_counts(*_baskets(spark, sf_dir))


@_register(
    f"""{_WITH_SPLIT} SELECT {_RATING_COLUMNS_SQL} FROM test
    WHERE {_USER_SEEN_SQL} AND {_ITEM_SEEN_SQL}"""
)
def clean_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed = split.with_split_bucket(basket_ratings(spark, sf_dir), MD5)
    return coldstart.clean_bucketed(bucketed)


_REPORT_SQL = f"""{_WITH_SPLIT},
    flagged AS (
        SELECT *, {_USER_SEEN_SQL} AS user_seen, {_ITEM_SEEN_SQL} AS item_seen FROM test)
    SELECT count(DISTINCT user_id) FILTER (WHERE NOT user_seen) AS unseen_users,
           count(DISTINCT item_id) FILTER (WHERE NOT item_seen) AS unseen_items,
           count(*) AS test_rows,
           count(*) FILTER (WHERE user_seen AND item_seen) AS clean_rows,
           round(count(*) FILTER (WHERE user_seen AND item_seen)
               / CAST(count(*) AS DOUBLE), 6) AS clean_coverage
    FROM flagged"""


@_register(_REPORT_SQL)
def coldstart_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucketed = split.with_split_bucket(basket_ratings(spark, sf_dir), MD5)
    return _rounded(coldstart.flag_report(coldstart.flag_bucketed(bucketed)))


@_register(
    f"""SELECT c.*, p.*, p.num_ratings AS source_rows, p.num_ratings - c.test_rows AS train_rows,
    CAST(0 AS BIGINT) AS rejected_rows, true AS reconciled
    FROM ({_REPORT_SQL}) c, (
        SELECT *, round(num_ratings / (CAST(users AS DOUBLE) * items), 6) AS density,
               round(1 - num_ratings / (CAST(users AS DOUBLE) * items), 6) AS sparsity
        FROM (SELECT count(*) AS num_ratings, count(DISTINCT user_id) AS users,
                     count(DISTINCT item_id) AS items, min(rating) AS min_rating,
                     max(rating) AS max_rating FROM ({BASKET_RATINGS_SQL}))) p"""
)
def prepared_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data-preparation workflow, reporting from the tables it stored."""
    out = work_path(spark, "prepared")
    return _rounded(workflows.prepare(basket_ratings(spark, sf_dir), out, MD5))


# --- Training, scoring, experiments ----------------------------------------------------


@_register(
    """SELECT round(sqrt(avg(power(1 + floor((l_quantity - 1) / 10)
        - (1 + 40 * l_discount), 2))), 6) AS rmse FROM lineitem"""
)
def rmse_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").select(
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias(S.RATING),
        (1 + 40 * F.col("l_discount")).alias(als.PREDICTION),
    )
    return _rounded(evaluate.rmse_of(scored))


def _blocks(spark: SparkSession, **changes: object) -> als.ALSParams:
    """Parameters with a block count that grows with the cluster."""
    return als.ALSParams(**changes).for_cluster(spark)


def _basket_blocks(spark: SparkSession, sf_dir: str) -> als.ALSParams:
    """Parameters with a block count that grows with the cluster and with the ratings.

    All ratings are counted, from the Parquet footers; a training set holds nine tenths of them.
    """
    return als.ALSParams().for_cluster(spark, basket_ratings(spark, sf_dir).count())


@_register(
    f"""{_WITH_SPLIT} SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS solved,
    count(DISTINCT item_id) AS items, 5 * count(DISTINCT item_id) AS item_elements FROM train"""
)
def als_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both factor tables: the users whose normal equations hold, and the item elements.

    The last half-step of a fit solves for the users, given the items.
    """
    train, _ = _baskets(spark, sf_dir)
    params = _basket_blocks(spark, sf_dir)
    model = als.fit(train, params)
    solved = als.normal_equations(model, train, params)
    users = solved.agg(F.count("*").alias("users"), F.count_if("solved").alias("solved"))
    elements = als.factor_elements(als.item_factors(model))
    items = elements.agg(
        F.count_if(F.col("position") == 0).alias("items"), F.count("*").alias("item_elements")
    )
    return users.select("*", *(items.select(c).scalar().alias(c) for c in items.columns))


@_register(
    f"""{_WITH_SPLIT} SELECT DISTINCT 'user' AS side, CAST(user_id AS INTEGER) AS id, 5 AS num_features FROM train
    UNION ALL SELECT DISTINCT 'item', CAST(item_id AS INTEGER), 5 FROM train"""
)
def als_factor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _baskets(spark, sf_dir)
    model = als.fit(train, _basket_blocks(spark, sf_dir))
    users = als.user_factors(model).withColumn("side", F.lit("user"))
    items = als.item_factors(model).withColumn("side", F.lit("item"))
    size = F.size(als.FEATURES).alias("num_features")
    return users.unionByName(items).select("side", als.FACTOR_ID, size)


@_register(
    f"""{_WITH_SPLIT} SELECT {_RATING_COLUMNS_SQL}, true AS is_product FROM test
    WHERE {_USER_SEEN_SQL} AND {_ITEM_SEEN_SQL}"""
)
def als_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows a model predicts, and whether each prediction is the factors' product."""
    train, test = _baskets(spark, sf_dir)
    model = als.fit(train, _basket_blocks(spark, sf_dir))
    product = F.abs(F.col(als.PREDICTION) - F.col("product")) < 1e-4
    scored = als.with_product(model, als.score(model, test))
    return scored.select(*S.RATING_COLUMNS, product.alias("is_product"))


_WIDE = 1 << 33


@_register(
    f"""{_WITH_SPLIT} SELECT user_id + {_WIDE} AS user_id, -item_id - {_WIDE} AS item_id, rating,
    timestamp, true AS is_product FROM test WHERE {_USER_SEEN_SQL} AND {_ITEM_SEEN_SQL}"""
)
def als_wide_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``als_predictions`` for keys beyond INT on either side of 0, by a dictionary of dense ids."""
    wide = {S.USER: F.col(S.USER) + _WIDE, S.ITEM: -F.col(S.ITEM) - _WIDE}
    train, test = (part.withColumns(wide) for part in _baskets(spark, sf_dir))
    model = ids.fit_keyed(train, _basket_blocks(spark, sf_dir))
    users = model.user_factors().withColumnsRenamed({S.USER: "_user", als.FEATURES: "_u"})
    items = model.item_factors().withColumnsRenamed({S.ITEM: "_item", als.FEATURES: "_v"})
    scored = model.score_all(test).filter(F.col(als.PREDICTION).isNotNull())
    joined = scored.join(users, F.col(S.USER) == F.col("_user")).join(
        items, F.col(S.ITEM) == F.col("_item")
    )
    product = F.abs(F.col(als.PREDICTION) - als.product_of("_u", "_v")) < 1e-4
    return joined.select(*S.RATING_COLUMNS, product.alias("is_product"))


@_register("SELECT count(*) AS num_ratings, true AS learned FROM lineitem")
def als_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit on all line items, with ratings of planted low rank: RMSE against the mean's."""
    u, i = F.pmod(S.USER, F.lit(5)), F.pmod(S.ITEM, F.lit(4))
    planted = order_ratings(spark, sf_dir).withColumn(
        S.RATING, ((1 + u) * (1 + i) / 4.0).cast("double")
    )
    model = als.fit(planted, _blocks(spark, rank=2))
    scored = als.score_all(model, planted)
    return scored.agg(
        F.count("*").alias("num_ratings"),
        (F.sqrt(F.avg((F.col(S.RATING) - F.col(als.PREDICTION)) ** 2)) < F.stddev_pop(S.RATING) / 4)
        .alias("learned"),
    )


@_register("SELECT true AS equal")
def als_logged_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RMSE in a run's log record, against the stored predictions of the same fit."""
    train, test = _baskets(spark, sf_dir)
    params = _basket_blocks(spark, sf_dir)
    record = evaluate.run_once(train, test, params)
    path = work_path(spark, "predictions")
    write_parquet(als.score(als.fit(train, params), test), path)
    error = F.col(S.RATING) - F.col(als.PREDICTION)
    again = spark.read.parquet(path).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return again.select((F.abs(F.col("rmse") - record["rmse"]) < 1e-4).alias("equal"))


@_register(
    f"""{_WITH_SPLIT} SELECT count(*) AS test_count,
    count(*) FILTER (WHERE {_USER_SEEN_SQL} AND {_ITEM_SEEN_SQL}) AS prediction_count,
    round(count(*) FILTER (WHERE {_USER_SEEN_SQL} AND {_ITEM_SEEN_SQL})
        / CAST(count(*) AS DOUBLE), 6) AS coverage FROM test"""
)
def als_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _baskets(spark, sf_dir)
    scored = als.score_all(als.fit(train, _basket_blocks(spark, sf_dir)), test)
    metrics = evaluate.prediction_metrics(scored)
    return _rounded(metrics.select("test_count", "prediction_count", "coverage"))


def _without_timings(log: DataFrame, *columns: str) -> DataFrame:
    """The columns of a run log that SQL can check, and whether the others were measured."""
    measured = (F.col("training_time") > 0) & (F.col("rmse") > 0)
    counts = ("train_count", "test_count", "prediction_count", "coverage")
    return _rounded(log.select(*columns, *counts, measured.alias("measured")))


_COVERAGE_SQL = """round(prediction_count / CAST(test_count AS DOUBLE), 6) AS coverage,
    true AS measured"""


@_register(
    f"""WITH r AS ({BASKET_RATINGS_SQL}),
    f AS (SELECT *, {_FOLD_SQL} AS fold FROM r),
    seen AS (
        SELECT fold, count(*) OVER () AS total,
               count(*) OVER (PARTITION BY user_id)
                   > count(*) OVER (PARTITION BY user_id, fold)
               AND count(*) OVER (PARTITION BY item_id)
                   > count(*) OVER (PARTITION BY item_id, fold) AS clean
        FROM f),
    sizes AS (
        SELECT fold, any_value(total) - count(*) AS train_count, count(*) AS test_count,
               count(*) FILTER (WHERE clean) AS prediction_count
        FROM seen GROUP BY fold),
    grid AS (
        SELECT * FROM (SELECT unnest([5, 10, 20]) AS rank),
            (SELECT unnest([0.05, 0.1, 0.15])::DOUBLE AS reg_param),
            (SELECT unnest([5, 10]) AS max_iter))
    SELECT fold, 'r' || rank || '-l' || reg_param || '-i' || max_iter
               AS model_name,
           rank, reg_param, max_iter,
           train_count, test_count, prediction_count, {_COVERAGE_SQL}
    FROM sizes, grid"""
)
def als_cv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds x 18 configurations, four fits at a time, or more where they are small."""
    ratings = basket_ratings(spark, sf_dir)
    params, together = als.ALSParams().side_by_side(spark, ratings.count(), 4)
    grid = sweep.config_grid(base=params)
    log = sweep.cross_validate_hashed(ratings, grid, 5, MD5, parallelism=together)
    return _without_timings(log, "fold", "model_name", "rank", "reg_param", "max_iter")


_SPLIT_SIZES_SQL = f"""{_WITH_SPLIT},
    sizes AS (
        SELECT (SELECT count(*) FROM train) AS train_count, count(*) AS test_count,
               count(*) FILTER (WHERE {_USER_SEEN_SQL} AND {_ITEM_SEEN_SQL})
                   AS prediction_count
        FROM test)"""


@_register(
    f"""{_SPLIT_SIZES_SQL}, b AS (SELECT unnest([2, 4, 10, 20]) AS blocks),
    k AS (SELECT unnest([1, 2, 3]) AS run)
    SELECT run, blocks AS num_user_blocks, blocks AS num_item_blocks,
           train_count, test_count, prediction_count, {_COVERAGE_SQL} FROM sizes, b, k"""
)
def als_block_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four block counts x 3 runs, six fits at a time: two blocks alone are two tasks.

    Checkpoints every iteration let each fit drop the shuffle files of those before.
    """
    params = als.ALSParams(checkpoint_interval=als.CHECKPOINT_OFTEN)
    with checkpoint_folder(spark):
        log = sweep.block_sweep(*_baskets(spark, sf_dir), params=params, parallelism=6)
    return _without_timings(log, "run", "num_user_blocks", "num_item_blocks")


@_register(
    f"""{_WITH_SPLIT},
    slots AS (SELECT user_id, item_id, {_SAMPLE_SQL} AS slot FROM train),
    fractions AS (SELECT unnest([25, 50, 100]) AS percent),
    sizes AS (
        SELECT percent,
               (SELECT count(*) FROM slots WHERE slot < percent * 10000) AS train_count,
               (SELECT count(*) FROM test) AS test_count,
               (SELECT count(*) FROM test
                WHERE user_id IN (SELECT user_id FROM slots WHERE slot < percent * 10000)
                  AND item_id IN (SELECT item_id FROM slots WHERE slot < percent * 10000))
                   AS prediction_count
        FROM fractions),
    k AS (SELECT unnest([1, 2, 3]) AS run)
    SELECT run, percent / 100.0::DOUBLE AS subset_fraction,
           train_count, test_count, prediction_count, {_COVERAGE_SQL} FROM sizes, k"""
)
def als_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sweep.size_sweep(
        *_baskets(spark, sf_dir),
        params=_basket_blocks(spark, sf_dir),
        sample=partial(split.hash_sample, mode=MD5),
    )
    return _without_timings(log, "run", "subset_fraction")


@_register(
    f"""{_SPLIT_SIZES_SQL}, k AS (SELECT unnest([1, 2, 3]) AS run)
    SELECT run, 'baskets' AS dataset, 'ALS' AS algorithm, train_count,
           prediction_count AS test_count, prediction_count,
           CAST(1 AS DOUBLE) AS coverage, true AS measured FROM sizes, k"""
)
def als_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _baskets(spark, sf_dir)
    clean = coldstart.clean_test(train, test)
    log = sweep.repeated_runs(train, clean, _basket_blocks(spark, sf_dir), dataset="baskets")
    return _without_timings(log, "run", "dataset", "algorithm")


# --- Run-log summaries -----------------------------------------------------------------

_CORE_SQL = """count(*) AS num_runs, avg(training_time) AS mean_time,
    stddev(training_time) AS std_time, avg(rmse) AS mean_rmse, stddev(rmse) AS std_rmse,
    avg(coverage) AS mean_coverage"""
_CORE_ROUNDED_SQL = """num_cores, num_runs, round(mean_time, 6) AS mean_time,
    round(std_time, 6) AS std_time, round(mean_rmse, 6) AS mean_rmse,
    round(std_rmse, 6) AS std_rmse, round(mean_coverage, 6) AS mean_coverage"""
_SCALED_SQL = """round(base / mean_time, 6) AS speedup,
    round(base / mean_time / num_cores, 6) AS efficiency"""


@_register(
    f"""{_WITH_LOG} SELECT rank, reg_param, max_iter, round(avg(rmse), 6) AS mean_rmse,
    round(stddev(rmse), 6) AS std_rmse, round(avg(training_time), 6) AS mean_time,
    count(*) AS num_folds FROM r GROUP BY rank, reg_param, max_iter"""
)
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runlog.grid_summary(event_run_log(spark, sf_dir)))


@_register(
    f"""{_WITH_LOG} SELECT num_user_blocks, num_item_blocks, round(avg(rmse), 6) AS mean_rmse,
    round(stddev(rmse), 6) AS std_rmse, round(avg(training_time), 6) AS mean_time,
    round(stddev(training_time), 6) AS std_time
    FROM r GROUP BY num_user_blocks, num_item_blocks ORDER BY mean_time"""
)
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = runlog.block_summary(event_run_log(spark, sf_dir))
    return _rounded(runlog.best_first(summary, "mean_time"))


@_register(
    f"""{_WITH_LOG} SELECT subset_fraction, train_count,
    round(avg(training_time), 6) AS mean_time, round(stddev(training_time), 6) AS std_time,
    round(avg(rmse), 6) AS mean_rmse, round(avg(coverage), 6) AS mean_coverage
    FROM r GROUP BY subset_fraction, train_count ORDER BY train_count"""
)
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runlog.size_summary(event_run_log(spark, sf_dir)))


@_register(
    f"""{_WITH_LOG}, s AS (SELECT num_cores, {_CORE_SQL} FROM r GROUP BY num_cores)
    SELECT {_CORE_ROUNDED_SQL} FROM s"""
)
def core_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runlog.core_summary(event_run_log(spark, sf_dir)))


@_register(
    f"""{_WITH_LOG}, s AS (SELECT num_cores, {_CORE_SQL} FROM r GROUP BY num_cores),
    b AS (SELECT mean_time AS base FROM s WHERE num_cores = 1)
    SELECT {_CORE_ROUNDED_SQL}, {_SCALED_SQL} FROM s, b ORDER BY num_cores"""
)
def scaling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runlog.scaling_report(event_run_log(spark, sf_dir)))


@_register(
    f"""{_WITH_LOG},
    s AS (SELECT dataset, num_cores, {_CORE_SQL} FROM r GROUP BY dataset, num_cores),
    b AS (SELECT dataset, mean_time AS base FROM s WHERE num_cores = 1)
    SELECT s.dataset, {_CORE_ROUNDED_SQL}, {_SCALED_SQL}
    FROM s LEFT JOIN b ON s.dataset = b.dataset ORDER BY s.dataset, num_cores"""
)
def scaling_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runlog.scaling_report(event_run_log(spark, sf_dir), ["dataset"]))


@_register(
    f"""{_WITH_LOG} SELECT num_cores, run, training_time, rmse, coverage FROM r
    ORDER BY num_cores, run"""
)
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_listing(event_run_log(spark, sf_dir))


@_register(
    f"""{_WITH_LOG} SELECT DISTINCT rank, reg_param, max_iter,
    'r' || rank || '-l' || reg_param || '-i' || max_iter AS model_name
    FROM r"""
)
def config_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.named_configs(event_run_log(spark, sf_dir))


@_register(
    f"""{_WITH_LOG}, c AS (SELECT DISTINCT rank, reg_param, max_iter FROM r)
    SELECT count(*) AS num_configs, count(*) AS num_names, true AS names_unique FROM c"""
)
def config_names_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.name_uniqueness(sweep.named_configs(event_run_log(spark, sf_dir)))


# --- Sources and sinks -----------------------------------------------------------------


def _write_text(ratings: DataFrame, path: str, separator: str, header: str | None) -> str:
    """Ratings as delimited text files, for the readers to read back."""
    line = F.concat_ws(separator, *S.RATING_COLUMNS).alias("value")
    if header is None:
        ratings.select(line).write.text(path)
    else:
        names = header.split(separator)
        ratings.toDF(*names).write.option("header", True).option("sep", separator).csv(path)
    return path


def _text(spark: SparkSession, sf_dir: str, separator: str, header: str | None = None) -> str:
    ratings = order_ratings(spark, sf_dir)
    return _write_text(ratings, work_path(spark, "text"), separator, header)


@_register(_ALL_ORDERS)
def source_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tab(spark, _text(spark, sf_dir, "\t")).ratings


@_register(_ALL_ORDERS)
def source_tab_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tab(spark, _text(spark, sf_dir, "\t"), infer_schema=True).ratings


@_register(_ALL_ORDERS)
def source_double_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_double_colon(spark, _text(spark, sf_dir, "::")).ratings


@_register(_ALL_ORDERS)
def source_header_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text(spark, sf_dir, ",", "userId,movieId,rating,timestamp")
    return read_header_csv(spark, path).ratings


# What is wrong with a line, by the last digit of its item, and how the line then ends.
_FAULTS = {
    1: ("?", "::3.0::1"),
    2: ("7.5", "::3.0::1"),
    3: ("7", "::3.0::late"),
    4: ("7", "::3.0::1::9"),
    5: ("7", "::3.0"),
    6: ("7", "::Infinity::1"),
    7: ("7", "::::1"),
    8: ("9223372036854775808", "::3.0::1"),
    9: ("7", "::3.0::"),
}


@_register(
    f"""{_WITH_ORDERS} SELECT item_id % 10 <> 0 AS rejected, count(*) AS num_rows
    FROM r GROUP BY 1"""
)
def source_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines but those of items ending in 0 get one of nine faults; the reader keeps exactly
    those apart: unreadable, fractional and oversized users, wrong or missing timestamps and
    ratings, a fifth field, a missing field, an infinite rating."""
    ratings = order_ratings(spark, sf_dir)
    line = F.concat_ws("::", *S.RATING_COLUMNS)
    for digit, (user, rest) in _FAULTS.items():
        broken = F.concat(F.lit(f"{user}::"), F.col(S.ITEM).cast("string"), F.lit(rest))
        line = F.when(F.col(S.ITEM) % 10 == digit, broken).otherwise(line)
    path = work_path(spark, "text")
    ratings.select(line.alias("value")).write.text(path)
    kept, rejected = read_double_colon(spark, path)
    both = kept.select(F.lit(False).alias("rejected")).unionByName(
        rejected.select(F.lit(True).alias("rejected"))
    )
    return both.groupBy("rejected").agg(F.count("*").alias("num_rows"))


@_register(
    f"""{_WITH_ORDERS}, f AS (SELECT *, {_FOLD_SQL} AS own, item_id % 7 = 0 AS bad FROM r),
    k AS (SELECT unnest(range(5)) AS n)
    SELECT CAST(n + 1 AS INTEGER) AS fold, count(*) FILTER (WHERE NOT bad AND own <> n) AS train_rows,
           count(*) FILTER (WHERE NOT bad AND own = n) AS test_rows,
           count(*) FILTER (WHERE bad) AS rejected_rows,
           round(avg(rating) FILTER (WHERE NOT bad AND own = n), 6) AS mean_test_rating
    FROM f, k GROUP BY n"""
)
def source_fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ready-made fold files, written from one table and read back pair by pair. Lines of
    every seventh item have no rating and are counted as rejected."""
    base = work_path(spark, "folds")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rating = F.when(F.col(S.ITEM) % 7 == 0, F.lit("")).otherwise(F.col(S.RATING).cast("string"))
    member = F.when(F.col("n") == F.col(split.FOLD), F.lit("test")).otherwise(F.lit("base"))
    # A rating's line is made once and then goes to its five files.
    line = F.concat_ws("\t", S.USER, S.ITEM, rating, S.TIMESTAMP).alias("value")
    lines = split.with_fold(order_ratings(spark, sf_dir), 5, MD5).select(line, split.FOLD)
    number = (F.col("n") + 1).cast("string")
    lines.withColumn("n", numbers).select(
        "value", F.concat(F.lit("u"), number, F.lit("."), member).alias("part")
    ).write.partitionBy("part").text(base)

    # One scan of the ten files: kept rows are counted by part, the others as rejected.
    parsed = read_folds(spark, base, range(1, 6), "part=u{fold}.base", "part=u{fold}.test")
    kind = F.when(F.col(USABLE), F.col("part")).otherwise("rejected").alias("kind")
    rows = parsed.source.select("fold", kind, S.RATING)
    return _rounded(
        rows.groupBy("fold").agg(
            *(
                F.count_if(F.col("kind") == kind).alias(f"{kind}_rows")
                for kind in ("train", "test", "rejected")
            ),
            F.avg(F.when(F.col("kind") == "test", F.col(S.RATING))).alias("mean_test_rating"),
        )
    )


@_register(_ALL_ORDERS)
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "parquet")
    write_parquet(order_ratings(spark, sf_dir), path)
    return read_parquet(spark, path).ratings


@_register(
    f"""{_WITH_LOG}, s AS (SELECT num_cores, {_CORE_SQL} FROM r GROUP BY num_cores),
    b AS (SELECT mean_time AS base FROM s WHERE num_cores = 1)
    SELECT {_CORE_ROUNDED_SQL}, {_SCALED_SQL} FROM s, b"""
)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "csv")
    summary = _rounded(runlog.scaling_report(event_run_log(spark, sf_dir)))
    write_single_csv(summary, path, "num_cores")
    return spark.read.schema(summary.schema).option("header", True).csv(path)


@_register(f"{_WITH_LOG} SELECT * FROM r")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "json")
    log = event_run_log(spark, sf_dir)
    write_json(log, path)
    return spark.read.schema(log.schema).json(path)


@_register(f"{_WITH_LOG} SELECT * FROM r")
def sink_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "runs")
    write_parquet(event_run_log(spark, sf_dir), path)
    return spark.read.parquet(path)


# --- Layout ----------------------------------------------------------------------------


@_register(
    f"""{_WITH_ORDERS} SELECT CAST(64 AS BIGINT) AS partitions, count(*) AS num_rows, true AS balanced
    FROM r"""
)
def partition_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition after a repartition into 64, put into one row."""
    balance = layout.partition_balance(order_ratings(spark, sf_dir), 64)
    mean = F.sum("num_rows") / F.count("*")
    return balance.agg(
        F.count("*").alias("partitions"),
        F.sum("num_rows").alias("num_rows"),
        ((F.min("num_rows") > mean * 0.5) & (F.max("num_rows") < mean * 1.5)).alias("balanced"),
    )


@_register(
    f"""{_WITH_ORDERS} SELECT rating, count(*) AS num_rows, true AS placed FROM r GROUP BY rating"""
)
def group_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group once, in the one of 200 partitions that its key hashes to."""
    placed = layout.group_partitions(order_ratings(spark, sf_dir), S.RATING)
    own = F.col(layout.PARTITION) == F.pmod(F.hash(S.RATING), F.lit(200))
    return placed.select(S.RATING, "num_rows", own.alias("placed"))


@_register(
    f"""{_WITH_ORDERS} SELECT CAST(48 AS INTEGER) AS wide, CAST(5 AS INTEGER) AS merged,
    count(*) AS num_rows FROM r"""
)
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of a frame after a repartition, and after merging them without a shuffle."""
    wide = order_ratings(spark, sf_dir).repartition(48)
    merged = wide.coalesce(5)
    return merged.agg(F.count("*").alias("num_rows")).select(
        F.lit(layout.partition_count(wide)).alias("wide"),
        F.lit(layout.partition_count(merged)).alias("merged"),
        "num_rows",
    )


@_register(
    f"""{_WITH_ORDERS}, w AS (SELECT unnest([2, 200]) AS width)
    SELECT CAST(width AS INTEGER) AS shuffle_partitions,
           count(DISTINCT rating) AS num_groups, count(*) AS num_rows, true AS equal
    FROM r, w GROUP BY width"""
)
def shuffle_width_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = layout.shuffle_width_report(order_ratings(spark, sf_dir), [S.RATING])
    return report.select("shuffle_partitions", "num_groups", "num_rows", "equal")
