from __future__ import annotations

import json

from pyspark.sql import functions as F

from data import plan, random_ratings, rows
from ratewright import schema as S
from ratewright.operators import als, coldstart, holdout, split, sweep
from ratewright.operators.layout import scoped_conf
from ratewright.plans import workflows
from ratewright.sources import read_fold, read_tab


def test_prepare_then_train(spark, tmp_path):
    ratings = random_ratings(spark, n=900, users=300, items=250)
    train, test = split.hash_split(ratings)
    out = str(tmp_path / "prepared")
    (report,) = workflows.prepare(ratings, out).collect()
    want = coldstart.coldstart_report(train, test).first().asDict()
    assert {k: report[k] for k in want} == want
    assert (report.source_rows, report.train_rows, report.num_ratings) == (900, train.count(), 900)
    assert report.rejected_rows == 0 and report.reconciled

    stored_train, stored_test = workflows.read_split(spark, out)
    clean = workflows.read_clean_test(spark, out)
    assert stored_train.schema.simpleString() == S.RATINGS.simpleString()
    assert (rows(stored_train), rows(stored_test)) == (rows(train), rows(test))
    assert rows(clean) == rows(coldstart.clean_test(train, test))

    quick = als.ALSParams(rank=2, max_iter=1, num_user_blocks=2, num_item_blocks=2)
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    workflows.timed_training(stored_train, clean, first, quick, 1, "d", num_cores=1)
    earlier = workflows.read_runs(spark, first)
    summary = workflows.timed_training(
        stored_train, clean, second, quick, 2, "d", num_cores=2, earlier_runs=earlier
    )
    one, two = summary.collect()
    assert (one.num_cores, one.num_runs, one.speedup) == (1, 1, 1.0)
    assert (two.num_cores, two.num_runs) == (2, 2) and two.mean_coverage == 1.0
    assert two.efficiency == two.speedup / 2
    csv = spark.read.option("header", True).csv(f"{second}/summary_csv")
    assert csv.count() == 2 and csv.columns == summary.columns

    # Another dataset in the same folder: logs add up, and its runs stay apart.
    both = workflows.timed_training(stored_train, clean, second, quick, 1, "other", num_cores=2)
    assert [(r.dataset, r.num_runs, r.speedup) for r in both.collect()] == [
        ("d", 2, None), ("other", 1, None),
    ]
    assert workflows.read_runs(spark, second).count() == 3


def test_prepare_counts_rejected_rows_and_notices_a_lost_one(spark, tmp_path, monkeypatch):
    path = tmp_path / "r.tsv"
    path.write_text("".join(f"{i % 9}\t{i % 7}\t3.0\t{i}\n" for i in range(60)) + "x\t1\t3.0\t1\n")
    parsed = read_tab(spark, str(path))
    (report,) = workflows.prepare(parsed, str(tmp_path / "a")).collect()
    assert (report.source_rows, report.rejected_rows, report.reconciled) == (60, 1, True)
    (kept_apart,) = spark.read.parquet(str(tmp_path / "a" / "rejected")).collect()
    line = json.loads(kept_apart.row)
    assert line["_corrupt_record"] == "x\t1\t3.0\t1" and line["source_file"].endswith("r.tsv")

    whole = workflows.read_split
    monkeypatch.setattr(
        workflows, "read_split",
        lambda s, out: (whole(s, out)[0].filter("timestamp != 17"), whole(s, out)[1].filter("timestamp != 17")),
    )
    (report,) = workflows.prepare(parsed, str(tmp_path / "b")).collect()
    assert not report.reconciled


def test_reconciliation_sees_a_lost_row(spark):
    ratings = random_ratings(spark, n=300)
    train, test = split.hash_split(ratings)
    assert split.split_reconciliation(ratings, train, test).first().reconciled
    assert not split.split_reconciliation(ratings, train.limit(3), test).first().reconciled


def test_stored_key_sets_are_broadcast_only_below_the_threshold(spark, tmp_path):
    out = str(tmp_path / "prepared")
    workflows.prepare(random_ratings(spark), out)
    _, test = workflows.read_split(spark, out)
    users, items = (workflows.read_key_words(spark, out, k) for k in ("user_id", "item_id"))
    found = plan(coldstart.flag_seen(test, users, items))
    assert found.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in found
    with scoped_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": 1}):
        found = plan(coldstart.flag_seen(test, users, items))
    assert found.count("SortMergeJoin") == 2 and "Broadcast" not in found


def test_grid_search_over_fold_files(spark, tmp_path):
    folded = split.with_fold(random_ratings(spark, n=900, users=60, items=50), 2)
    for number in (1, 2):
        for part, name in zip(split.fold_pair(folded, number - 1), ("base", "test"), strict=True):
            path = str(tmp_path / f"u{number}.{name}")
            bad = spark.createDataFrame([("x\t1\t1.0\t1",)], "value string")
            lines = part.select(F.concat_ws("\t", *S.RATING_COLUMNS).alias("value"))
            lines.unionByName(bad).write.text(path)
    quick = als.ALSParams(num_user_blocks=2, num_item_blocks=2)
    grid = sweep.config_grid((1, 2), (0.1,), (1,), quick)
    folds = ((n, *read_fold(spark, str(tmp_path), n)) for n in (1, 2))
    summary = workflows.grid_search(folds, str(tmp_path / "out"), grid).collect()
    assert [r.num_folds for r in summary] == [2, 2] and {r.rank for r in summary} == {1, 2}
    assert summary[0].mean_rmse <= summary[1].mean_rmse
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 4
    stored = spark.read.json(str(tmp_path / "out" / "grid_runs"))
    assert {(r.fold, r.model_name) for r in stored.collect()} == {
        (n, name) for n in (1, 2) for name in grid
    }


def test_bucketed_split_needs_no_shuffle_on_users(spark, tmp_path):
    out = str(tmp_path / "it's here")
    workflows.prepare(random_ratings(spark, n=2000), out)
    workflows.bucket_split(spark, out, 4)
    train, test = workflows.read_bucketed_split(spark, out)
    assert [rows(f) for f in (train, test)] == [rows(f) for f in workflows.read_split(spark, out)]
    with scoped_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        totals, held = holdout.user_totals(train), holdout.user_holdout(train)
        known = test.join(train.select("user_id").distinct(), "user_id", "left_semi")
        for frame in (totals, held, known):
            found = plan(frame)
            assert "Exchange hashpartitioning(user_id" not in found and "Exchange rangepart" not in found
            assert "Bucketed: true" in found
    plain = workflows.read_split(spark, out)[0]
    assert rows(held) == rows(holdout.user_holdout(plain)) and rows(totals) == rows(holdout.user_totals(plain))
