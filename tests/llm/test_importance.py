from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from ratewright.llm import importance
from ratewright.llm.text import WordHashes

LABELS = "doc_id bigint, quality int"


def test_counts_and_weights_by_hand(docs, prose, odd):
    rows = [(i, prose(30, i)) for i in range(20)] + [r[:2] for r in odd]
    counts = importance.ngram_counts(docs(rows))
    want = Counter()
    for _, text in rows:
        want.update(importance._buckets((text or "").encode(), WordHashes()).tolist())
    assert {b: n for b, n in enumerate(counts) if n} == want
    target = np.zeros(importance.BUCKETS, np.int64)
    target[list(want)[:50]] = 3
    ratios = importance.log_ratios(target, counts)
    size = importance.BUCKETS
    for b in list(want)[:5] + list(want)[-5:]:
        p = (target[b] + 1) / (target.sum() + size)
        q = (counts[b] + 1) / (counts.sum() + size)
        assert ratios[b] == pytest.approx(math.log(p / q))
    for r in importance.weigh(docs(rows), ratios).filter("doc_id < 20 AND doc_id >= 11").collect():
        own = importance._buckets(dict(rows)[r.doc_id].encode(), WordHashes()).astype(int)
        assert r.log_weight == pytest.approx(ratios[own].sum())


@pytest.mark.parametrize("k", [1, 7, 50, 199, 200])
def test_top_k_by_counting(spark, k, monkeypatch):
    monkeypatch.setattr(importance, "BINS", 8)
    maker = random.Random(k)
    rows = [(maker.randint(-5, 5) * 10 ** maker.randint(0, 9), maker.getrandbits(63)) for _ in range(200)]
    least = importance.top_k(spark.createDataFrame(rows, "key bigint, tie bigint"), k)
    assert [r for r in rows if r >= least] and sorted(rows)[-k:] == sorted(r for r in rows if r >= least)


def test_equal_rows_stand_together(spark):
    rows = [(1, 5)] * 10 + [(2, 1)]
    frame = spark.createDataFrame(rows, "key bigint, tie bigint")
    assert sum(r >= importance.top_k(frame, 4) for r in rows) == 1
    assert sum(r >= importance.top_k(frame, 11) for r in rows) == 11


def test_selection_prefers_the_target(spark, docs, prose):
    good = [(i, prose(60, i, words=50)) for i in range(100)]
    poor = [(100 + i, prose(60, i, words=50)[::-1]) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(0, 200, 2)], LABELS)
    found = importance.resample(docs(good + poor), labels).collect()
    assert len(found) == 200 and sum(r.selected for r in found) == 100
    assert sum(r.selected for r in found if r.doc_id < 100) > 95
    again = importance.resample(docs(good + poor, 7), labels).collect()
    assert sorted((r.doc_id, r.selected) for r in again) == sorted((r.doc_id, r.selected) for r in found)


def test_gumbel_draw_follows_the_weights(spark):
    """Two equal halves with weights 3 : 1: of a small draw about three quarters come from the first."""
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(
        F.shiftrightunsigned(F.xxhash64("id"), 1).alias("tie"), (F.col("id") % 2).alias("heavy")
    )
    key = F.when(F.col("heavy") == 1, math.log(3.0)).otherwise(0.0) + importance._gumbel(F.xxhash64("tie"))
    keyed = rows.withColumn("key", F.floor(key * importance.RESOLUTION))
    least, tie = importance.top_k(keyed.select("key", "tie"), 2000)
    chosen = keyed.filter((F.col("key") > least) | ((F.col("key") == least) & (F.col("tie") >= tie)))
    assert abs(chosen.agg(F.avg("heavy")).first()[0] - 0.75) < 0.03


def test_odd_texts_empty_tables_and_clashing_columns(spark, docs, odd, clashing):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (10, 1)], LABELS)
    found = importance.resample(docs(odd), labels).collect()
    assert len(found) == len(odd) and all(math.isfinite(r.log_weight) for r in found)
    assert importance.resample(docs([]), labels).count() == 0
    none = labels.filter("quality = 0")
    assert {r.log_weight for r in importance.resample(docs(odd), none).collect()} == {0.0}
    assert importance.resample(clashing([(1, "a"), (2, "b")]), labels).count() == 2


def plain_buckets(text):
    """Buckets of words and pairs with whole numbers, word by word."""
    import xxhash

    top = (1 << 64) - 1

    def spread(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    hashes = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) & top for a, b in zip(hashes, hashes[1:], strict=False)]
    return [spread(h) % importance.BUCKETS for h in hashes] + [spread(p) % importance.BUCKETS for p in pairs]


def test_query_by_definition(spark, sf_dir):
    """Both models, the weights, the keys and the selection, recomputed plainly."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from ratewright.llm.queries import op1_importance

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1}
    tie = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(importance.SEED)), 1)
    rows = docs.select("doc_id", "text", tie.alias("tie"), F.xxhash64(tie).alias("noise")).collect()
    raw, aim = Counter(), Counter()
    for r in rows:
        raw.update(plain_buckets(r.text))
        if r.doc_id in good:
            aim.update(plain_buckets(r.text))
    share = lambda c, b: (c[b] + importance.SMOOTHING) / (sum(c.values()) + importance.SMOOTHING * importance.BUCKETS)
    ratio = [math.log(share(aim, b)) - math.log(share(raw, b)) for b in range(importance.BUCKETS)]
    want = {}
    for r in rows:
        weight = sum(ratio[b] for b in plain_buckets(r.text))
        unit = (((r.noise & ((1 << 64) - 1)) >> 12) + 0.5) / (1 << 52)
        want[r.doc_id] = (weight, weight - math.log(-math.log(unit)), r.tie)
    kept = sorted(want, key=lambda d: (want[d][1], want[d][2]), reverse=True)[: int(0.5 * len(rows))]
    found = {r.doc_id: r for r in op1_importance(spark, sf_dir).collect()}
    assert found.keys() == want.keys()
    for d, r in found.items():
        assert math.isclose(r.log_weight, want[d][0], rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(r.key, want[d][1], rel_tol=1e-9, abs_tol=1e-6)
    assert {d for d, r in found.items() if r.selected} == set(kept)
