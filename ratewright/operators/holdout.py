"""Per-user random holdout: a random position for each rating within its user, the user's
total, and a validation quota from that total.

The position orders a user's ratings by a content hash and then by every column, so it does
not depend on the partitioning. ``ranking.row_numbers`` gives the positions: one window per
user, and a distributed rank by range for users too large for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright import schema as S
from ratewright.functions import order_hash
from ratewright.functions.hashing import XXHASH64
from ratewright.operators import ranking
from ratewright.operators.ranking import HOT_ROWS, ROW_NUM, TOTAL

QUOTA = "val_count"
HELD_OUT = "held_out"

SHUFFLE_SALT = "holdout"

_ORDER = "_order"
_TIE_BREAK = (S.ITEM, S.TIMESTAMP, S.RATING)


def user_totals(ratings: DataFrame) -> DataFrame:
    """Ratings per user, one row per user."""
    return ratings.groupBy(S.USER).agg(F.count("*").alias(TOTAL))


def shuffle_rank(ratings: DataFrame, mode: str = XXHASH64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``row_num`` (1..total, random order) and ``total`` to every rating.

    ``hot_rows`` changes the way large users are ranked, not the ranks.
    """
    order = order_hash(S.RATING_COLUMNS, mode, SHUFFLE_SALT)
    rows = ratings.select(*S.RATING_COLUMNS).withColumn(_ORDER, order)
    return ranking.row_numbers(rows, [S.USER], [_ORDER, *_TIE_BREAK], hot_rows).select(
        *S.RATING_COLUMNS, ROW_NUM, TOTAL
    )


def with_quota(ranked: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Add ``val_count``: how many of the user's ratings go to validation."""
    return ranked.withColumn(QUOTA, F.floor(F.col(TOTAL) * F.lit(fraction)))


def user_holdout(
    ratings: DataFrame, fraction: float = 0.2, mode: str = XXHASH64, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every rating with rank, total, quota and ``held_out``.

    The first ``val_count`` ratings of each user's random order are held out.
    """
    ranked = with_quota(shuffle_rank(ratings, mode, hot_rows), fraction)
    return ranked.withColumn(HELD_OUT, F.col(ROW_NUM) <= F.col(QUOTA))


def holdout_pair(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and validation ratings of an annotated frame, in the canonical columns."""
    columns = S.RATING_COLUMNS
    return (
        held.filter(~F.col(HELD_OUT)).select(*columns),
        held.filter(F.col(HELD_OUT)).select(*columns),
    )
