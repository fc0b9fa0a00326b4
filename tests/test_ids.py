from __future__ import annotations

from data import low_rank, plan, ratings, rows
from ratewright.operators import als, evaluate, ids

PARAMS = als.ALSParams(rank=3, max_iter=4, num_user_blocks=2, num_item_blocks=2)
WIDE = 1 << 40


def wide(frame):
    return frame.selectExpr(f"user_id * 3 - {WIDE} AS user_id", f"item_id + {WIDE} AS item_id", "rating", "timestamp")


def test_dictionary_is_dense_and_stored(spark, tmp_path):
    frame = ratings(spark, [(WIDE * i, i, 1.0, 0) for i in (3, -1, 7, 3)] + [(None, 1, 1.0, 0)])
    found = ids.dictionary(frame, "user_id", str(tmp_path / "d"))
    assert rows(found) == [(-WIDE, 0), (3 * WIDE, 1), (7 * WIDE, 2)]
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3


def test_wide_keys_learn_like_small_ones(spark):
    train, test = low_rank(spark)
    model = ids.fit_keyed(wide(train), PARAMS)
    scored = model.score_all(wide(test))
    assert scored.columns == [*test.columns, "prediction"]
    found = evaluate.prediction_metrics(scored).first()
    want = evaluate.prediction_metrics(als.score_all(als.fit(train, PARAMS), test)).first()
    assert (found.test_count, found.prediction_count) == (want.test_count, want.prediction_count)
    assert abs(found.rmse - want.rmse) < 0.2
    assert rows(model.user_factors().select("user_id")) == rows(wide(train).select("user_id").distinct())
    assert rows(model.item_factors().select("item_id")) == rows(wide(train).select("item_id").distinct())


def test_unseen_and_missing_keys_have_no_prediction(spark):
    train = ratings(spark, [(WIDE + u, -WIDE - i, 3.0, 0) for u in range(4) for i in range(4)])
    model = ids.fit_keyed(train, PARAMS)
    test = ratings(spark, [(WIDE, -WIDE, 3.0, 1), (0, -WIDE, 3.0, 1), (WIDE, 0, 3.0, 1), (None, None, 3.0, 1)])
    found = model.score_all(test).collect()
    assert [(r.user_id, r.item_id) for r in found if r.prediction is not None] == [(WIDE, -WIDE)]
    assert len(found) == 4


def test_the_fit_reads_stored_rows(spark, monkeypatch):
    """ALS runs the shuffles of its input's plan twice: the joins to the numbers come before it."""
    seen, fit = [], als.fit
    monkeypatch.setattr(als, "fit", lambda rows, params: seen.append(rows) or fit(rows, params))
    train = wide(low_rank(spark)[0])
    ids.fit_keyed(train, PARAMS)
    assert "Exchange" not in plan(seen[0]) and "Join" not in plan(seen[0])
    assert seen[0].count() == train.count()
