"""SimHash fingerprints and exact near-duplicate groups by vantage-point trees.

A text's fingerprint has 64 bits; bit i is set if it is set in more than half of the hashes of
its 3-word shingles. Two texts are linked if their fingerprints differ in at most ``max_bits``.

Equal fingerprints are one class before anything is compared. Links between classes come from
vantage-point trees: a node has a vantage point and a radius, its inner branch holds the
fingerprints within the radius and its outer branch the rest. By the triangle inequality a
fingerprint with distance d to the vantage point can have partners within r only where the
branch reaches [d - r, d + r]; so one that is inside, but within r of the boundary, also visits
the outer branch. One of each pair crosses, which is enough to meet.

A tree over all 64 bits prunes badly, as random distances crowd around 32. The fingerprint is
cut into four parts of 16 bits, and of two fingerprints within r one part is within r // 4: there
is a tree over each part, with the small search radius r // 4. A part has 65,536 values, so the
number of classes with each is counted once, and the driver builds the trees from those counts:
every node takes that of some of its values as vantage point, with that radius, which leaves the
fewest pairs to compare, and nodes end at ``SHARD_CLASSES`` classes. Up to r = 3 nothing crosses there, and a class is in four
shards however many classes there are. A leaf that is still large, because one value has very many
classes, goes on over each of the other three parts, of which one is within r // 3, by trees with
crossings; these are as fine as the largest leaf needs.

Each shard is searched in blocks, all pairs exactly, and returns its members' smallest partner
in the shard, not its pairs: the components over those links are the groups.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; a
text of fewer words than a shingle is hashed whole; repeated rows share their fingerprint and
component; a null id takes part, and is never the name of a component that has another id;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.components import component_labels
from ratewright.llm.text import document_keys, utf8
from ratewright.sources import work_path

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
# Nodes with more classes are divided further.
SHARD_CLASSES = 128
# Values that a node tries as vantage point. Where rows cross, a node is divided if that leaves
# less than this share of its pairs to be compared.
VANTAGES = 4
WORTH = 0.8
# Leaves this many times larger go on over the other parts.
LARGE = 8
# Rows of a shard that are compared with the shard at once: bounds the memory of a search.
BLOCK_ROWS = 512
PARTS = 4
PART_BITS = 16
VALUES = 1 << PART_BITS


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: lowers A-Z only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = zip(*(words[j:] for j in range(shingle_words)), strict=False)
    hashes = np.fromiter(
        (digest(join(s), SEED) for s in shingles), np.uint64, len(words) - shingle_words + 1
    )
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(set_bits * 2 > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(
    docs: DataFrame, carry: list, text_col: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """The columns in ``carry`` and ``fp``, the fingerprint as a signed BIGINT, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fp = np.array([fingerprint(t.as_py(), shingle_words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(fp.view(np.int64))],
                names=[*batch.schema.names[:-1], "fp"],
            )

    rows = docs.select(*carry, utf8(text_col).alias("_text"))
    kinds = "".join(f"{n} {t}, " for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}fp bigint")


def part_values(fps: np.ndarray, part: int) -> np.ndarray:
    """The bits of one part, as numbers below ``VALUES``."""
    return ((fps.view(np.uint64) >> np.uint64(PART_BITS * part)) & np.uint64(VALUES - 1)).astype(np.int64)


class Tree(NamedTuple):
    """The leaves of every value of a part: ``leaves[first[v]:first[v + 1]]``."""

    first: np.ndarray
    leaves: np.ndarray
    sizes: np.ndarray  # classes in each leaf

    def place(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``values``, leaf), one for every leaf that a value visits."""
        begin, n = self.first[values], np.diff(self.first)[values]
        within = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        return np.repeat(np.arange(len(values)), n), self.leaves[np.repeat(begin, n) + within]


def build_tree(counts: np.ndarray, reach: int, limit: int) -> Tree:
    """The vantage-point tree over the values of a part, given the classes with each value, for
    partners within ``reach``. Nodes of up to ``limit`` classes, of one value, or that no radius
    divides well are leaves."""
    ends, sizes = [], []
    nodes = [np.flatnonzero(counts)]
    while nodes:
        values = nodes.pop()
        weight = counts[values]
        split = None
        if len(values) > 1 and weight.sum() > limit:
            worth = (WORTH if reach else 1.0) * weight.sum() ** 2.0
            for vantage in values[:: -(-len(values) // VANTAGES)]:
                d = np.bitwise_count(values ^ vantage)
                below = np.bincount(d, weight, minlength=PART_BITS + 1).cumsum()
                # By radius: the classes of the inner branch, and of the outer one with those
                # that cross.
                inner = below[:-1]
                outer = below[-1] - np.concatenate([np.zeros(reach), inner])[: len(inner)]
                pairs = inner**2 + outer**2
                if pairs.min() < worth:
                    worth, radius = pairs.min(), int(pairs.argmin())
                    split = [values[d <= radius], values[d + reach > radius]]
        if split is None:
            ends.append(values)
            sizes.append(int(weight.sum()))
        else:
            nodes += split
    value = np.concatenate(ends)  # one empty leaf, if there are no classes
    leaf = np.repeat(np.arange(len(ends)), [len(x) for x in ends])
    order = np.argsort(value, kind="stable")
    first = np.searchsorted(value[order], np.arange(VALUES + 1))
    return Tree(first.astype(np.int32), leaf[order].astype(np.int32), np.array(sizes))


class Forest(NamedTuple):
    """A tree over each part, and, if some leaf is large, those that go on below such leaves."""

    trees: list[Tree]
    further: list[Tree]
    large: int  # classes above which a leaf goes on

    def place(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a fingerprint, shard), one for every shard that it visits."""
        owners, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts = [part_values(fps, part) for part in range(PARTS)]
        for part, tree in enumerate(self.trees):
            owner, leaf = tree.place(parts[part])
            shard = (leaf.astype(np.int64) * PARTS + part) << 32
            large = tree.sizes[leaf] > self.large
            owners.append(owner[~large])
            shards.append(shard[~large])
            if not large.any():
                continue
            for other, below in enumerate(self.further):
                if other != part:
                    at, branch = below.place(parts[other][owner[large]])
                    owners.append(owner[large][at])
                    shards.append(shard[large][at] + (other << 30) + branch)
        return np.concatenate(owners), np.concatenate(shards)


def plant(counts: np.ndarray, max_bits: int) -> Forest:
    """The trees for classes of which ``counts[part, value]`` have that value in that part."""
    trees = [build_tree(own, max_bits // PARTS, SHARD_CLASSES) for own in counts]
    large, largest = LARGE * SHARD_CLASSES, max(int(tree.sizes.max()) for tree in trees)
    if largest <= large:
        return Forest(trees, [], large)
    reach, limit = max_bits // (PARTS - 1), SHARD_CLASSES * int(counts[0].sum()) // largest
    return Forest(trees, [build_tree(own, reach, limit) for own in counts], large)


def value_counts(fps: np.ndarray) -> np.ndarray:
    """How many fingerprints have each value of each part."""
    return np.stack([np.bincount(part_values(fps, p), minlength=VALUES) for p in range(PARTS)])


def _counts(classes: DataFrame) -> np.ndarray:
    """``value_counts`` of all classes: at most ``PARTS`` x ``VALUES`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, VALUES), np.int64)
        for batch in batches:
            counts += value_counts(batch.column(0).to_numpy())
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": cell, "n": counts.ravel()[cell]})

    summed = (
        classes.select("fp")
        .mapInArrow(count, "cell bigint, n bigint")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros(PARTS * VALUES, np.int64)
    counts[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return counts.reshape(PARTS, VALUES)


def shard_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): every fingerprint of a shard with a partner there, and the smallest of its group.

    All pairs are compared, in blocks; labels spread over them until none changes. What comes
    back is linear in the shard, however many pairs are near.
    """
    fps = np.unique(fps)  # sorted as signed numbers
    bits = fps.view(np.uint64)

    def blocks(x: np.ndarray):
        for at in range(0, len(x), BLOCK_ROWS):
            rows = slice(at, min(at + BLOCK_ROWS, len(x)))
            yield rows, np.bitwise_count(x[rows, None] ^ x[None, :]) <= max_bits

    has = np.zeros(len(fps), bool)
    for rows, near in blocks(bits):
        has[rows] = near.sum(axis=1) > 1  # each is near itself
    fps, bits = fps[has], bits[has]
    label = np.arange(len(fps))
    while True:
        lower = label.copy()
        for rows, near in blocks(bits):
            lower[rows] = np.where(near, label[None, :], len(fps)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints (``fp``) that connect all within reach."""
    forest = plant(_counts(classes), max_bits)
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            owner, shard = shared.value.place(fps)
            yield pa.RecordBatch.from_pydict({"fp": fps[owner], "shard": shard})

    placed = classes.select("fp").mapInArrow(place, "fp bigint, shard bigint")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; one shard at a time is held."""
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            fps = np.concatenate([x["fp"].to_numpy() for x in held])
            held.clear()
            a, b = shard_links(fps, max_bits)
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=False):
                if held and held[-1]["shard"].iloc[0] != shard:
                    yield flush()
                held.append(rows)
        if held:
            yield flush()

    return (
        placed.repartition("shard")
        .sortWithinPartitions("shard")
        .mapInPandas(search, "a bigint, b bigint")
    )


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp`` and ``label`` (the smallest fingerprint reachable) of every different ``fp``."""
    spark = prints.sparkSession
    path = work_path(spark, "classes")
    prints.select("fp").distinct().write.parquet(path)
    classes = spark.read.schema("fp bigint").parquet(path)
    labels = component_labels(links(classes, max_bits)).withColumnRenamed("node", "fp")
    return classes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id of all
    reachable rows), one row per row of ``docs``."""
    prints = _stored(fingerprints(docs, [F.col(id_col).alias("id")], text_col, shingle_words))
    lowest = prints.groupBy("fp").agg(F.min("id").alias("low"))
    grouped = groups(prints, max_bits).join(lowest, "fp")
    heads = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
    named = grouped.join(heads, "label").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row of each group, with the columns of ``docs``: the one with the smallest id (null
    last), of repeated rows any."""
    keys = document_keys(docs, id_col, text_col)
    prints = _stored(
        fingerprints(docs, [*keys, F.col(id_col).isNull().alias("_no_id")], text_col, shingle_words)
    )
    firsts = prints.groupBy("fp").agg(F.min(F.struct("_no_id", "_id", "_th")).alias("first"))
    heads = (
        groups(prints, max_bits).join(firsts, "fp")
        .groupBy("label").agg(F.min("first").alias("first"))
        .select("first._id", "first._th")
    )
    rows = docs.select(*keys, F.struct(*docs.columns).alias("row"))
    kept = rows.join(heads, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    return kept.select("row.*")


def _stored(prints: DataFrame) -> DataFrame:
    path = work_path(prints.sparkSession, "fingerprints")
    prints.write.parquet(path)
    return prints.sparkSession.read.schema(prints.schema).parquet(path)
