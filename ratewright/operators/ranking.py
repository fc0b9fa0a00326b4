"""Row numbers over all rows, and within groups, without gathering any group in one task.

``numbered`` sorts by range: the rows are dealt out by ranges of the order, sorted within their
partition and stored with partition and place. The row counts of the partitions, one number
each, are added up, and a row's number is its partition's offset plus its place. Equal rows have
a salt as their last sort key, so a range boundary may fall between them too.

``row_numbers`` counts the groups first, with one partial row per group and task. The groups
with more than ``hot_rows`` rows are numbered by range, all together; a group's numbers start at
its lowest position. All other rows take one window per group, so each row is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.sources import work_path

ROW_NUM = "row_num"
TOTAL = "total"
POSITION = "position"

HOT_ROWS = 200_000
# So many groups at most are numbered by range, the largest. Every other one has fewer rows than
# a ten-thousandth of the table, or than ``hot_rows``.
HOT_GROUPS = 10_000

_PLACE_BITS = 33  # of monotonically_increasing_id: the place, below the partition number
_AT, _SALT, _PART = "_at", "_salt", "_part"


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = POSITION) -> DataFrame:
    """All rows with their position, from 0, in ``order``. Rows equal in ``order`` are next to
    each other in no given order. The sorted rows are stored below the work folder."""
    spark = rows.sparkSession
    path = work_path(spark, "numbered")
    keys = [*order, _SALT]
    (
        rows.withColumn(_SALT, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(_SALT)
        .withColumn(_AT, F.monotonically_increasing_id())
        .write.parquet(path)
    )
    kinds = T.StructType([*rows.schema.fields, T.StructField(_AT, T.LongType())])
    part = F.shiftright(F.col(_AT), _PLACE_BITS)
    stored = spark.read.schema(kinds).parquet(path).withColumn(_PART, part)
    counts = sorted(stored.groupBy(_PART).count().collect())  # a row per shuffle partition
    offsets, before = [], 0
    for number, size in counts:
        offsets.append((number, before))
        before += size
    lower = F.broadcast(spark.createDataFrame(offsets, "_number bigint, _offset bigint"))
    place = F.col(_AT).bitwiseAND((1 << _PLACE_BITS) - 1)
    return stored.join(lower, F.col(_PART) == F.col("_number")).select(
        *rows.columns, (F.col("_offset") + place).alias(name)
    )


def hot_groups(rows: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS) -> list[tuple]:
    """The groups with more than ``hot_rows`` rows and their sizes, HOT_GROUPS at most."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias(TOTAL)).filter(F.col(TOTAL) > hot_rows)
    return [tuple(r) for r in sizes.orderBy(F.desc(TOTAL), *group).limit(HOT_GROUPS).collect()]


def row_numbers(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows with ``row_num`` (from 1, within the group, in ``order``) and ``total`` (rows of
    the group), both BIGINT. NULL is a group of its own.

    ``hot_rows`` moves rows between the two ways of numbering, not their numbers. Groups are
    counted when this is called.
    """
    spark = rows.sparkSession
    columns = rows.columns
    window = Window.partitionBy(*group).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hot = hot_groups(rows, group, hot_rows)

    def windowed(frame: DataFrame) -> DataFrame:
        place = F.row_number().over(window).cast("bigint")
        return frame.withColumns({ROW_NUM: place, TOTAL: F.count("*").over(whole)})

    if not hot:
        return windowed(rows)

    renamed = {g: f"_hot_{i}" for i, g in enumerate(group)}
    kinds = ", ".join(f"{renamed[g]} {rows.schema[g].dataType.simpleString()}" for g in group)
    known = spark.createDataFrame(hot, f"{kinds}, _hot_total bigint")  # HOT_GROUPS rows at most
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(renamed[g])) for g in group))
    cold = rows.join(F.broadcast(known), same, "left_anti")
    picked = rows.join(F.broadcast(known), same, "left_semi")
    placed = numbered(picked, [*group, *order])
    firsts = (
        placed.groupBy(*group)
        .agg(F.min(POSITION).alias("_first"), F.count("*").alias(TOTAL))
        .withColumnsRenamed(renamed)
    )
    ranked = placed.join(F.broadcast(firsts), same).select(
        *columns, (F.col(POSITION) - F.col("_first") + 1).alias(ROW_NUM), TOTAL
    )
    return windowed(cold).unionByName(ranked)
