"""Exact nearest neighbours by a block matrix join with an int8 bound.

Candidates are cut into tiles of about ``TILE_CANDIDATES`` vectors, each held by one task while
all queries pass it in blocks: only the queries, a fixed share of the table, are sent to every
tile, and a task holds one tile and one block. The vectors of a block and a tile are quantised
to int8 with a scale of their own. The product of the int8 blocks estimates all inner products
at once; the rounding of each component is at most half a step, which bounds each estimate's
error. A pair survives if its upper bound reaches the k-th best lower bound of its query;
survivors are recomputed in double precision from the original vectors and a heap keeps the k
best. The heaps of all tiles are merged per query.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take
no part, and neither do rows without id; a vector only meets vectors of its own length; ties go
to the smaller id. Every row is a candidate of every query but itself, also where ids or whole
rows repeat: such rows each take a rank, and each query row has ranks of its own. A query with
fewer candidates gets all; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_CANDIDATES = 4096
# Queries that are multiplied with a tile at once.
BLOCK_QUERIES = 512

# A query row is named by its id and a hash of its vector; copies are equal rows.
NEAR = "query_id bigint, vector bigint, rows bigint, vec_id bigint, score double, copies bigint"
FOUND = "query_id bigint, rank int, vec_id bigint, score double"
_NEAR_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
_FOUND_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]


def usable(embedding: Column) -> Column:
    """Whether a vector can take part."""
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return (
        embedding.isNotNull() & (F.size(embedding) > 0) & ~bad
        & F.exists(embedding, lambda x: x != 0)
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 components and the step of each vector: x is within half a step of step * int8."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    step[step == 0] = np.finfo(float).tiny  # the components are too small to divide
    return np.clip(np.rint(x / step), -127, 127).astype(np.int8), step[:, 0]


def bounds(
    queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products and how far each may be off."""
    (q, q_step), (c, c_step) = queries, candidates
    dim = q.shape[1]
    # Products of int8 are whole numbers; single precision holds sums below 2**24 exactly.
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    steps = q_step[:, None] * c_step[None, :]
    estimate = (q.astype(exact) @ c.astype(exact).T).astype(float) * steps
    q_sum = np.abs(q.astype(np.int64)).sum(axis=1)
    c_sum = np.abs(c.astype(np.int64)).sum(axis=1)
    # |sum (q+a)(c+b) - sum qc| <= (|q| + |c|) / 2 + dim / 4 for |a|, |b| <= 1/2.
    off = ((q_sum[:, None] + c_sum[None, :]) / 2 + dim / 4) * steps
    return estimate, off * (1 + 1e-9)


class _Vectors:
    """Rows of vectors of one length: ids, hashes, copies and components."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        whole = pa.Table.from_batches(batches)
        self.ids, self.hashes, self.copies = (
            whole.column(n).to_numpy() for n in ("id", "vector", "copies")
        )
        parts = [b.column("v") for b in batches]
        flat = [p.flatten().to_numpy(zero_copy_only=False).astype(float) for p in parts]
        self.x = np.concatenate(flat).reshape(len(self.ids), -1)


def _best_of_block(block: _Vectors, tile: _Vectors, c_int: tuple, k: int) -> Iterator[tuple]:
    """Rows of NEAR: of each query the best of the tile, k rows with their copies."""
    estimate, off = bounds(quantise(block.x), c_int)
    own = (block.ids[:, None] == tile.ids) & (block.hashes[:, None] == tile.hashes)
    left = tile.copies - own  # without the query itself
    low = np.where(left > 0, estimate - off, -np.inf)
    high = np.where(left > 0, estimate + off, -np.inf)
    kth = len(tile.ids) - min(k, len(tile.ids))
    reach = np.partition(low, kth, axis=1)[:, kth]
    for i in range(len(block.ids)):
        j = np.flatnonzero((high[i] >= reach[i]) & (left[i] > 0))
        scores = (tile.x[j] * block.x[i]).sum(axis=1)
        name = (int(block.ids[i]), int(block.hashes[i]), int(block.copies[i]))
        pairs = zip(scores.tolist(), (-tile.ids[j]).tolist(), left[i, j].tolist(), strict=True)
        for score, vec, copies in _heap(pairs, k):
            yield *name, -vec, score, copies


def _heap(pairs: Iterable[tuple[float, int, int]], k: int) -> list[tuple[float, int, int]]:
    """The best (score, -id, copies), best first, until there are k rows."""
    best, rows = [], 0
    for pair in heapq.nlargest(k, pairs):
        if rows >= k:
            break
        best.append(pair)
        rows += pair[2]
    return best


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tile, its candidates first; one tile and one block are held."""
        key, held, waiting, tile, c_int = None, [], [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tile, c_int
            if held and waiting:
                if tile is None:
                    tile = _Vectors(held)
                    c_int = quantise(tile.x)
                found = list(_best_of_block(_Vectors(waiting), tile, c_int, k))
                columns = zip(*found, strict=True) if found else [()] * len(_NEAR_KINDS)
                arrays = [pa.array(c, t) for c, t in zip(columns, _NEAR_KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in NEAR.split(", ")])
            waiting.clear()

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("dim", "tile", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                *place, kind = keys[start].tolist()
                if place != key:
                    yield from flush()
                    key, held, tile = place, [], None
                if kind == 0:
                    held.append(batch.slice(start, stop - start))
                    continue
                for at in range(start, stop, BLOCK_QUERIES):
                    waiting.append(batch.slice(at, min(BLOCK_QUERIES, stop - at)))
                    if sum(map(len, waiting)) >= BLOCK_QUERIES:
                        yield from flush()
        yield from flush()

    return search


def _merge(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query; the heap of one query is held."""
        query, held = None, []

        def ranked() -> list[tuple]:
            vecs = [(-v, score) for score, v, n in _heap(held, k) for _ in range(min(n, k))][:k]
            return [(query[0], i, v, s) for _ in range(query[2]) for i, (v, s) in enumerate(vecs, 1)]

        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for *name, vec, score, copies in zip(*columns, strict=True):
                if name != query:
                    if query is not None:
                        done += ranked()
                    query, held = name, []
                held.append((score, -vec, copies))
                if len(held) > 64 * k:
                    held = _heap(held, k)
            yield _found(done)
        if query is not None:
            yield _found(ranked())

    def _found(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(_FOUND_KINDS)
        arrays = [pa.array(c, t) for c, t in zip(columns, _FOUND_KINDS, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FOUND.split(", ")])

    return merge


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile_candidates: int = TILE_CANDIDATES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k nearest candidates
    by inner product, the query's own row left out."""

    def rows_of(frame: DataFrame, kind: int) -> DataFrame:
        rows = frame.select(
            F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")
        ).filter(F.col("id").isNotNull() & usable(F.col("v")))
        return rows.groupBy("id", "v").agg(F.count("*").alias("copies")).select(
            "id", "v", "copies", F.xxhash64("id", "v").alias("vector"),
            F.size("v").alias("dim"), F.lit(kind).alias("kind"),
        )

    c = rows_of(candidates, 0)
    count = max(1, -(-c.count() // tile_candidates))
    c = c.withColumn("tile", F.pmod("vector", F.lit(count).cast("bigint")))
    q = rows_of(queries, 1).withColumn("tile", F.explode(F.expr(f"sequence(0L, {count - 1}L)")))
    return (
        c.unionByName(q)
        .repartition("dim", "tile")
        .sortWithinPartitions("dim", "tile", "kind")
        .mapInArrow(_search(k), NEAR)
        .repartition("query_id")
        .sortWithinPartitions("query_id", "vector")
        .mapInArrow(_merge(k), FOUND)
    )
