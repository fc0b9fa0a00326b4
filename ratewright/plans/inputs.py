"""Ratings and run logs derived from the star-schema tables, each from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session time zone.

    Spark's ``unix_timestamp`` makes no calendar objects, but drops a fraction toward zero: before
    1970 the fields are added up, so that fractions are dropped downwards there too.
    """
    c = F.col(column)
    plain = c.cast("timestamp_ntz")
    days = F.unix_date(c.cast("date")).cast("bigint")
    by_field = days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    since = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(plain >= since, F.unix_timestamp(plain)).otherwise(by_field)


def _stars() -> Column:
    """1..5 from a quantity of 1..50."""
    return (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias(S.RATING)


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate parts: one row per line item. Dense, no test-only users or items."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("bigint").alias(S.USER),
        F.col("l_partkey").cast("bigint").alias(S.ITEM),
        _stars(),
        epoch_seconds("o_orderdate").alias(S.TIMESTAMP),
    )


def basket_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rate parts by line position: one row per line item, about four per user and
    per item, so that a tenth of the rows holds many users and items the rest does not."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias(S.USER),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).cast("bigint").alias(S.ITEM),
        _stars(),
        epoch_seconds("l_shipdate").alias(S.TIMESTAMP),
    )


def event_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log with one row per event; all values are functions of the event."""
    event = F.col("event_id")

    def pick(selector: Column, *values: object) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), selector.cast("int"))

    third, ninth, quarter = event % 3, F.floor(event / 3) % 3, event % 4
    cores = F.col("user_id") % 3
    return table(spark, sf_dir, "events").select(
        pick(event % 2, "first", "second").alias("dataset"),
        F.lit("ALS").alias("algorithm"),
        (1 + event % 5).cast("int").alias("fold"),
        (1 + third).cast("int").alias("run"),
        pick(cores, 1, 2, 4).alias("num_cores"),
        pick(cores, 0.25, 0.5, 1.0).alias("subset_fraction"),
        pick(cores, 1000, 2000, 4000).cast("bigint").alias("train_count"),
        (F.col("value") + 1).alias("training_time"),
        (0.8 + (event % 100) / 1000).alias("rmse"),
        (1 - (event % 10) / 100).alias("coverage"),
        pick(third, 5, 10, 20).alias("rank"),
        pick(ninth, 0.05, 0.1, 0.15).alias("reg_param"),
        pick(F.floor(event / 9) % 2, 5, 10).alias("max_iter"),
        pick(quarter, 1, 2, 4, 10).alias("num_user_blocks"),
        pick(quarter, 1, 2, 4, 10).alias("num_item_blocks"),
    )
