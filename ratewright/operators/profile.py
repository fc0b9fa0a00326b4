"""Profiling of the user-item matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import schema as S
from ratewright.functions import ratio
from ratewright.operators import keybits


def rating_values(ratings: DataFrame) -> DataFrame:
    """The distinct rating values, ascending."""
    return ratings.select(S.RATING).distinct().orderBy(S.RATING)


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """Number of ratings per rating value."""
    return ratings.groupBy(S.RATING).agg(F.count("*").alias("num_ratings"))


def key_bits(ratings: DataFrame, *by: str) -> DataFrame:
    """The mergeable state of a profile: per kind of key (``key`` is the column's name) and
    bitmap word the ``bits`` of the keys, with the ratings and the range of values counted on
    the users' words; for each group of ``by`` its own. One scan; a task hands on words, not keys."""

    def kind(key: str) -> Column:
        counted = F.lit(1 if key == S.USER else 0).cast("bigint")
        value = F.col(S.RATING) if key == S.USER else F.lit(None).cast("double")
        word, bit = keybits.word_of(F.col(key)), keybits.bit_of(F.col(key))
        return F.struct(
            F.lit(key).alias("key"), word.alias(keybits.WORD), bit.alias(keybits.BITS),
            counted.alias("num_ratings"), value.alias("min_rating"), value.alias("max_rating"),
        )

    rows = ratings.select(*by, F.inline(F.array(kind(S.USER), kind(S.ITEM))))
    return merge_key_bits(rows, *by)


def merge_key_bits(states: DataFrame, *by: str) -> DataFrame:
    """Profiles of parts as that of the whole: the same columns, a row per key and word."""
    return states.groupBy(*by, "key", keybits.WORD).agg(
        F.bit_or(keybits.BITS).alias(keybits.BITS),
        F.sum("num_ratings").alias("num_ratings"),
        F.min("min_rating").alias("min_rating"),
        F.max("max_rating").alias("max_rating"),
    )


def profile_of(states: DataFrame) -> DataFrame:
    """The profile from merged states (``merge_key_bits``)."""
    cells = F.col("users").cast("double") * F.col("items").cast("double")

    def keys(key: str) -> Column:
        return keybits.size_of(F.when(F.col("key") == key, F.col(keybits.BITS)))

    sizes = states.agg(
        F.coalesce(F.sum("num_ratings"), F.lit(0)).cast("bigint").alias("num_ratings"),
        keys(S.USER).alias("users"),
        keys(S.ITEM).alias("items"),
        F.min("min_rating").alias("min_rating"),
        F.max("max_rating").alias("max_rating"),
    )
    return sizes.withColumn("density", ratio(F.col("num_ratings"), cells)).withColumn(
        "sparsity", 1 - F.col("density")
    )


def matrix_profile(ratings: DataFrame) -> DataFrame:
    """One row: sizes, rating range, density and sparsity of the user-item matrix.

    Users and items are counted exactly, from bitmaps. Density is ratings per cell, so repeated
    ratings of one cell count each time.
    """
    return profile_of(key_bits(ratings))


def ratings_per_user(ratings: DataFrame) -> DataFrame:
    """Number of ratings of each user."""
    return ratings.groupBy(S.USER).agg(F.count("*").alias("num_ratings"))


def least_active_users(ratings: DataFrame, n: int = 5) -> DataFrame:
    """The n users with the fewest ratings; equal counts are ordered by user."""
    return ratings_per_user(ratings).orderBy(F.asc("num_ratings"), F.asc(S.USER)).limit(n)


def ratings_of_user(ratings: DataFrame, user_id: int) -> DataFrame:
    """All ratings of one user."""
    return ratings.filter(F.col(S.USER) == F.lit(user_id))


def preview(df: DataFrame, n: int = 5, *order_by: Column | str) -> DataFrame:
    """The first n rows; with ``order_by`` the choice of rows is reproducible."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
