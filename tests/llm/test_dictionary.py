from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewright.llm import dictionary

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = ["a", "b", "ab", "Word", "É", "é", "\xa0", "\x85", " ", ".", "-", "\n", "0", "9a", "{", "`", "\x7f", "\0", "中", "x" * 70]
texts = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


def features(text: bytes) -> list[bytes]:
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    return words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def buckets(text: bytes) -> Counter:
    return Counter(zlib.crc32(f) % dictionary.BUCKETS for f in features(text))


def brute(docs: list[tuple], target: list, percent=25, min_words=20):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    raw = sum((buckets((t or "").encode()) for _, t in docs), Counter())
    aim = sum((buckets((t or "").encode()) for t in target), Counter())
    S, T = sum(raw.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log(((aim[b] + 1) * float(S + 10_000)) / ((raw[b] + 1) * float(T + 10_000))))

    rows = []
    for doc_id, text in docs:
        found = features((text or "").encode())
        total = sum(gain(zlib.crc32(f) % 10_000) for f in found)
        weight = total // len(found) if found else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(found) >= 2 * min_words - 1))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    k = percent * len(drawn) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(drawn[:k])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@given(st.binary(max_size=80), st.binary(max_size=80))
def test_crc_of_joined_texts(a, b):
    assert dictionary.shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@given(st.lists(texts, max_size=6))
@settings(max_examples=300, deadline=None)
def test_buckets_by_definition(group):
    own = dictionary.Dictionary()
    for _ in range(2):  # with an empty dictionary, and with one that knows the words
        block = dictionary._Block(own, [t.encode() for t in group]) if group else None
        want = sum((buckets(t.encode()) for t in group), Counter())
        if block:
            counts = block.counts()
            assert {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)
            sizes, _ = block.sums(np.zeros(dictionary.BUCKETS, np.int64))
            assert sizes.tolist() == [len(features(t.encode())) for t in group]


def test_any_bytes_limits_and_pieces(monkeypatch, prose):
    group = [bytes(range(256)) * 3, b"", prose(500, 1).encode(), b"q" * 5000 + b" q", prose(300, 2).encode()]
    want = [buckets(t) for t in group]
    for limits in ({"PIECE_BYTES": 10}, {"LONGEST": 3}, {"MOST_WORDS": 5}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(dictionary, name, value)
            own = dictionary.Dictionary()
            for _ in range(3):
                counts = dictionary._Block(own, group).counts()
                assert {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(sum(want, Counter()))


def test_each_text_is_scanned_once_by_a_full_dictionary(monkeypatch):
    """More distinct words than the dictionary takes: no second scan, and it is not emptied."""
    monkeypatch.setattr(dictionary, "MOST_WORDS", 20)
    scanned, plain = [], dictionary.Dictionary._matches
    monkeypatch.setattr(
        dictionary.Dictionary, "_matches",
        lambda self, text: scanned.append(len(text)) or plain(self, text),
    )
    own, given = dictionary.Dictionary(), 0
    for k in range(8):
        group = [f"the Cat and {'the and ' * i} rare{k}n{i}, rare{k}n{i}".encode() for i in range(40)]
        want = sum((buckets(t) for t in group), Counter())
        counts = dictionary._Block(own, group).counts()
        assert {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)
        given += sum(len(t) + 2 for t in group)
    assert sum(scanned) <= given
    assert len(plain(own, b" the cat and ")) == 3


def test_a_full_dictionary_follows_a_change_of_words(monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_WORDS", 5)
    own = dictionary.Dictionary()
    for name in ("old", "new"):
        group = [" ".join(f"{name}{i}" for i in range(10) for _ in range(3)).encode()] * 2
        want = sum((buckets(t) for t in group), Counter())
        for _ in range(4):
            counts = dictionary._Block(own, group).counts()
            assert {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)
    assert len(own._matches(" ".join(f" new{i} " for i in range(10)).encode())) == 5


def run(spark, docs, target, **kwargs):
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    return dictionary.resample(docs, frame, **kwargs).collect()


def test_against_brute_force(spark, docs, odd, prose):
    rows = [r[:2] for r in odd] + [(1000 + i, prose(5 + i % 40, i, 60)) for i in range(150)]
    rows += [(2000, prose(30, 4))] * 3 + [(None, prose(25, 8))]
    target = [prose(200, i, 60) for i in range(3)] + [None, ""]
    found = run(spark, docs(rows), target)
    want = brute(rows, target)
    key = lambda r: (str(r[0]), r[4] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_ties_go_to_the_smaller_id(spark, docs, monkeypatch):
    monkeypatch.setattr(dictionary, "_noise", lambda *a: F.lit(0).cast("bigint"))
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    found = run(spark, docs([(i, text) for i in (9, 3, 7, 1, 5, 2, 8, 4)]), ["a b"], percent=50)
    assert {r.doc_id: r.rank for r in found} == {1: 1, 2: 2, 3: 3, 4: 4, 5: None, 7: None, 8: None, 9: None}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b")]])
def test_small_tables(spark, docs, rows):
    found = run(spark, docs(rows), [])
    assert ordered(found) == ordered(brute(rows, []))


def test_clashing_columns(spark, clashing):
    assert ordered(run(spark, clashing([(1, "a b")]), ["a"])) == ordered(brute([(1, "a b")], ["a"]))


def test_query(spark, sf_dir):
    from ratewright.llm.queries import op13_dictionary

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = op13_dictionary(spark, sf_dir).collect()
    assert ordered(found) == ordered(brute([tuple(r) for r in rows], target))
    assert sum(r.rank is not None for r in found) > 10
