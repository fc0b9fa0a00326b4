"""Connected components by rounds of joins, for edges of any number.

Each round gives every node the smallest label among its own and its neighbours' and then the
label of that label (pointer jumping), so the rounds grow with the logarithm of the diameter.
Sums and minima are combined before each shuffle; joins are on the node with one row per node
on one side, so a node with very many edges can be split. No edge or label reaches the driver,
which reads one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.sources import work_path


def component_labels(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node reachable) of every node in ``edges`` (a, b)."""
    spark = edges.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, name)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), "edges"
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("low")
        )
        own = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        after = stored(
            lower.join(own, "low", "left").select(
                "node", F.least("low", "jump").alias("label"), "before"
            ),
            "labels",
        )
        labels = after.select("node", "label")
        if after.filter("label != before").isEmpty():
            return labels
