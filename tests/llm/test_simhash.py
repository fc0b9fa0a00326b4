from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratewright.llm import simhash
from ratewright.llm.components import component_labels

MASK = (1 << 64) - 1


@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "B", "É", "\n", " ", "xyz"])).map("".join))
@settings(max_examples=200, deadline=None)
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


def clustered(n, seed):
    """Fingerprints around a few centres, at 0 to 5 bits from them, and chains of such."""
    maker = random.Random(seed)
    out = [0, MASK]
    for _ in range(n):
        base = maker.choice(out[-30:]) if maker.random() < 0.8 else maker.getrandbits(64)
        for _ in range(maker.randint(0, 5)):
            base ^= 1 << maker.randrange(64)
        out.append(base)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("max_bits", [0, 1, 3, 6])
def test_groups_against_all_pairs(spark, seed, max_bits, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_CLASSES", 4)  # deep trees
    prints = clustered(600, seed)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    found = {r.fp & MASK: r.label & MASK for r in simhash.groups(frame, max_bits).collect()}
    want = brute.components(list(enumerate(prints)), max_bits)
    groups = {}
    for i, p in enumerate(prints):
        assert groups.setdefault(found[p], want[i]) == want[i]
    assert len(groups) == len(set(want.values()))


def random_prints(n, seed):
    return np.unique(np.random.default_rng(seed).integers(-(1 << 63), 1 << 63, n, np.int64))


@pytest.mark.parametrize("shard, large", [(8, 1 << 40), (64, 0), (4, 1)])
@pytest.mark.parametrize("max_bits", [1, 3, 7])
def test_no_near_pair_is_lost_by_the_trees(monkeypatch, shard, large, max_bits):
    """Every pair within reach meets in a shard, also where large leaves go on."""
    monkeypatch.setattr(simhash, "SHARD_CLASSES", shard)
    monkeypatch.setattr(simhash, "LARGE", large)
    maker = np.random.default_rng(3)
    base = random_prints(3000, 3)
    base[1000:] = base[1000] ^ (base[1000:] & 0xFFFF00FF)  # two thirds share values of parts
    near = base.copy()
    for _ in range(max_bits):
        near ^= np.int64(1) << maker.integers(0, 63, len(base))
    both = np.concatenate([base, near])
    forest = simhash.plant(simhash.value_counts(np.unique(both)), max_bits)
    assert bool(forest.further) == (large < 1 << 40)
    homes = {}
    for owner, home in zip(*(x.tolist() for x in forest.place(both)), strict=True):
        homes.setdefault(owner, set()).add(home)
    assert all(homes[i] & homes[i + len(base)] for i in range(len(base)))


def compared(fps):
    """Compared pairs and shard rows for each class."""
    owner, shard = simhash.plant(simhash.value_counts(fps), simhash.MAX_BITS).place(fps)
    sizes = np.unique(shard, return_counts=True)[1].astype(float)
    return (sizes**2).sum() / len(fps), len(owner) / len(fps)


def test_work_grows_with_the_classes():
    (few, few_rows), (many, many_rows) = (compared(random_prints(n, 1)) for n in (10_000, 1_000_000))
    assert few_rows == many_rows == simhash.PARTS
    assert many < 2 * few


def test_a_hot_part_is_divided_further():
    """A third of the classes share one part: their shard goes on over the others."""
    fps = random_prints(200_000, 2)
    fps[: len(fps) // 3] &= ~0xFFFF
    pairs, rows = compared(np.unique(fps))
    assert pairs < len(fps) / 20 and rows < 40


def test_shard_links_of_a_large_group_are_few():
    maker = np.random.default_rng(5)
    fps = np.unique(np.int64(77) ^ (np.int64(1) << maker.integers(0, 63, 3000)))
    a, b = simhash.shard_links(fps, 3)
    assert len(a) < len(fps) and set(a) | set(b) == set(fps)


def test_near_duplicates_and_keep_one(docs, prose, odd):
    text = prose(300, 1)
    near = text.replace(text.split()[40], "changed", 1)
    rows = [(5, text), (3, near), (9, text), (7, prose(300, 2)), *[r[:2] for r in odd if r[0] not in (3, 5, 7, 9)]]
    found = simhash.near_duplicates(docs(rows)).collect()
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    group = brute.components(list(enumerate(f for _, f in prints)))
    ids = {}
    for i, (d, _) in enumerate(prints):
        ids.setdefault(group[i], []).append(d)
    low = {g: min((d for d in own if d is not None), default=None) for g, own in ids.items()}
    assert sorted(map(tuple, found), key=str) == sorted(
        ((d, f"{f:016x}", low[group[i]]) for i, (d, f) in enumerate(prints)), key=str
    )
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, low.values()))


def test_empty_table_and_clashing_columns(docs, clashing):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "x y z")]
    assert sorted(simhash.near_duplicates(clashing(rows)).collect()) == sorted(
        simhash.near_duplicates(docs(rows)).collect()
    )
    kept = simhash.keep_one(clashing(rows))
    assert kept.columns == clashing(rows).columns and kept.count() == 2


def test_query_on_given_documents(spark, sf_dir):
    from ratewright.llm.queries import op6_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute.fingerprint(r.text)) for r in docs]
    names = brute.components(prints)
    want = sorted((d, f"{f:016x}", names[d]) for d, f in prints)
    assert sorted(map(tuple, op6_simhash(spark, sf_dir).collect())) == want


def test_component_labels_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(7000, 7000)]
    labels = {
        r.node: r.label
        for r in component_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    }
    assert {labels[i] for i in range(201)} == {0}
    assert {labels[1000 + i] for i in range(100)} == {1000}
    assert component_labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_without_id_are_told_apart_by_more_than_32_bits(spark, docs):
    """Texts whose 32-bit hashes collide."""
    from pyspark.sql import functions as F

    texts = spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spread = texts.select(F.regexp_replace("text", "(.{8})", "$1 ").alias("text"), F.hash("text").alias("h"))
    spread = spread.withColumn("h", F.hash("text"))
    twice = spread.groupBy("h").agg(F.collect_set("text").alias("texts")).filter("size(texts) > 1")
    rows = [(None, t) for r in twice.collect() for t in r.texts]
    assert len(rows) >= 4
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t in rows)
