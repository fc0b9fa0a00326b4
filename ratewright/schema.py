"""Canonical schemas. Every operator reads and writes these column names and types."""

from __future__ import annotations

from pyspark.sql import types as T

USER = "user_id"
ITEM = "item_id"
RATING = "rating"
TIMESTAMP = "timestamp"

# Keys are BIGINT in every relational step; only ``als.fit`` needs them within INT. timestamp is
# epoch seconds, never a Spark timestamp.
RATINGS = T.StructType(
    [
        T.StructField(USER, T.LongType()),
        T.StructField(ITEM, T.LongType()),
        T.StructField(RATING, T.DoubleType()),
        T.StructField(TIMESTAMP, T.LongType()),
    ]
)
RATING_COLUMNS = tuple(RATINGS.fieldNames())

# The columns that identify a rating for hashing. The rating value is left out, so two
# ratings of one item by one user at one time always land on the same side of a split.
HASH_COLUMNS = (USER, ITEM, TIMESTAMP)

# One row per timed fit. Experiments fill the columns they vary and leave the rest NULL,
# so logs of different experiments can be unioned and grouped by dataset or model_name.
RUN_LOG = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("num_cores", T.IntegerType()),
        T.StructField("subset_fraction", T.DoubleType()),
        T.StructField("train_count", T.LongType()),
        T.StructField("test_count", T.LongType()),
        T.StructField("prediction_count", T.LongType()),
        T.StructField("training_time", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("reg_param", T.DoubleType()),
        T.StructField("max_iter", T.IntegerType()),
        T.StructField("num_user_blocks", T.IntegerType()),
        T.StructField("num_item_blocks", T.IntegerType()),
        # Fits that ran at the same time, this one among them: their times are not those of a
        # fit alone, so summaries keep them apart.
        T.StructField("concurrency", T.IntegerType()),
        # Names a fit of a grid: a digest of its fold and parameters.
        T.StructField("run_key", T.StringType()),
    ]
)
