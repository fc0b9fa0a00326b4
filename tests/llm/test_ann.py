from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.llm import ann

KIND = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(3)


def exact(queries, rows, k):
    """Sorted (query, rank, id, score): for each query row all other rows, sorted."""
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and good(v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q not in queries:
            continue
        others = [
            (-float((w * v).sum()), i) for n, (i, w) in enumerate(usable) if n != at and len(w) == len(v)
        ]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def found(rows, queries, spark, **options):
    all_rows = frame(spark, rows)
    result = ann.nearest(all_rows.filter(F.col("vec_id").isin(*queries)), all_rows, **options)
    return sorted(map(tuple, result.collect()))


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b], rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("limits", [(512, 4096), (7, 50)])
def test_against_sorting_everything(spark, limits, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", limits[0])
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    queries = list(range(0, 400, 20))
    got = found(rows, queries, spark, tile_candidates=limits[1])
    same(got, exact(queries, rows, 20))


def test_ties_nulls_zeros_lengths_and_repeats(spark):
    one, nan, inf = [1.0, 0.5], float("nan"), float("inf")
    rows = [(i, one) for i in range(60)]  # all equal
    rows += [(100, None), (101, []), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]),
             (106, [1.0, 2.0, 3.0]), (107, [3.0, 2.0, 1.0]), (None, one), (0, one), (7, one), (7, [9.0, 9.0]),
             (108, [1e-40, 0.0]), (109, [3e38, 3e38])]
    queries = [0, 5, 7, 102, 103, 106, 108, 109]
    same(found(rows, queries, spark, k=20), exact(queries, rows, 20))
    same(found(rows, queries, spark, k=20, tile_candidates=5), exact(queries, rows, 20))


def test_every_other_row_is_a_candidate_where_ids_repeat(spark):
    """Equal rows, and rows that share an id only, among the queries and among the candidates."""
    random = np.random.default_rng(6)
    rows = [(i, random.normal(size=4).astype(np.float32).tolist()) for i in range(30)]
    rows += [rows[0]] * 3 + [rows[3]] * 40 + [(20, rows[1][1]), (20, rows[2][1]), (3, rows[5][1])]
    for size in (4096, 8):
        same(found(rows, [0, 20], spark, k=20, tile_candidates=size), exact([0, 20], rows, 20))
    small = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [3.0, 0.0])]
    same(found(small, [20], spark), exact([20], small, 20))


def test_candidates_are_shuffled_once_and_queries_to_every_tile(spark):
    rows = [(i, [1.0 + i, 1.0]) for i in range(200)]
    every = frame(spark, rows)
    result = ann.nearest(every.filter("vec_id % 20 = 0"), every, tile_candidates=50)
    assert found(rows, list(range(0, 200, 20)), spark, tile_candidates=50) == sorted(map(tuple, result.collect()))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_bounds_hold():
    random = np.random.default_rng(1)
    for scale in (1e-6, 1.0, 1e6):
        q = random.normal(size=(40, 48)) * scale
        c = random.standard_cauchy(size=(60, 48))
        estimate, off = ann.bounds(ann.quantise(q), ann.quantise(c))
        assert (np.abs(q @ c.T - estimate) <= off).all()


def test_fewer_candidates_and_empty_tables(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert found(rows, [0], spark, k=20) == [(0, 1, 1, 2.0), (0, 2, 2, -1.0)]
    assert found([], [0], spark) == []
    assert found([(0, [1.0])], [0], spark) == []


def test_query(spark, sf_dir):
    from ratewright.llm.queries import op10_nearest

    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    queries = {i for i, _ in rows if i % 20 == 0}
    same(sorted(map(tuple, op10_nearest(spark, sf_dir).collect())), exact(queries, rows, 20))
