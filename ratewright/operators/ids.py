"""ALS on keys of any size: a stored dictionary from BIGINT keys to dense INT ids.

Spark's ALS takes INT ids. The distinct users and items of the training set are numbered from 0
by a distributed sort (``ranking.numbered``) and stored; training rows are joined to the numbers
and stored before the fit, and factors and predictions are joined back to their keys. Up to 2^31
different keys of a kind can be numbered.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright import schema as S
from ratewright.operators import als, ranking
from ratewright.sources import work_path

DENSE = "dense"
MOST_IDS = 1 << 31


def dictionary(rows: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """``key`` and ``dense`` (INT, from 0) for every distinct key, stored at ``path``."""
    spark = rows.sparkSession
    path = path or work_path(spark, f"ids-{key}")
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    numbered = ranking.numbered(keys, [key], DENSE).withColumn(DENSE, F.col(DENSE).cast("bigint"))
    numbered.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    highest = stored.agg(F.max(DENSE)).first()[0]
    if highest is not None and highest >= MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} different values of {key}")
    return stored.select(key, F.col(DENSE).cast("int").alias(DENSE))


class KeyedModel(NamedTuple):
    """An ALS model with the dictionaries of its ids."""

    model: ALSModel
    users: DataFrame
    items: DataFrame

    def user_factors(self) -> DataFrame:
        """``user_id`` BIGINT and ``features``."""
        return self._keyed(als.user_factors(self.model), self.users, S.USER)

    def item_factors(self) -> DataFrame:
        """``item_id`` BIGINT and ``features``."""
        return self._keyed(als.item_factors(self.model), self.items, S.ITEM)

    @staticmethod
    def _keyed(factors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        return factors.join(ids, factors[als.FACTOR_ID] == ids[DENSE]).select(key, als.FEATURES)

    def score_all(self, test: DataFrame) -> DataFrame:
        """Every test rating, ``prediction`` NULL where the user or the item is unseen."""
        given = (S.USER, S.ITEM)
        kept = {f"_{k}": F.col(k) for k in given}
        rows = _numbered(test.withColumns(kept), self.users, self.items, "left")
        # An unseen key has no number; -1 is nobody's, so the model leaves it out.
        rows = rows.withColumns({k: F.coalesce(k, F.lit(-1)) for k in given})
        scored = als.score_all(self.model, rows)
        back = [F.col(f"_{c}").alias(c) if c in given else F.col(c) for c in test.columns]
        return scored.select(*back, als.PREDICTION)


def _numbered(rows: DataFrame, users: DataFrame, items: DataFrame, how: str) -> DataFrame:
    """Rows with dense ids in place of their keys."""
    for key, ids in ((S.USER, users), (S.ITEM, items)):
        known = ids.select(F.col(key).alias("_known"), F.col(DENSE).alias("_dense"))
        joined = rows.join(known, F.col(key) == F.col("_known"), how)
        rows = joined.withColumn(key, F.col("_dense")).drop("_known", "_dense")
    return rows


def fit_keyed(train: DataFrame, params: als.ALSParams = als.ALSParams()) -> KeyedModel:
    """Train on canonical ratings with keys of any size."""
    users, items = dictionary(train, S.USER), dictionary(train, S.ITEM)
    rows = als.stored(_numbered(train, users, items, "inner"))
    return KeyedModel(als.fit(rows, params), users, items)
