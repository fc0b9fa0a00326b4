from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import brute
import numpy as np
import pytest

from ratewright.llm import decontam

ITEMS = "item_id bigint, text string"


def fold(text):
    codes, _ = decontam.folded([text])
    return "".join(map(chr, codes[1:].tolist())).strip()


def edited(text, edits, seed):
    maker, chars = random.Random(seed), list(text)
    for _ in range(edits):
        at = maker.randrange(len(chars))
        kind = maker.random()
        if kind < 0.4:
            chars[at] = maker.choice("abcdefgh")
        elif kind < 0.7:
            del chars[at]
        else:
            chars.insert(at, maker.choice("abcdefgh"))
    return "".join(chars)


@pytest.fixture(scope="module")
def cases(prose):
    items = [(i, prose(30, 9000 + i)) for i in range(6)]
    rows = []
    for k in range(60):
        _, text = items[k % 6]
        part = edited(text, k // 4, k)
        rows.append((k, f"{prose(40, k)}. {part.upper() if k % 3 == 0 else part}! {prose(30, 300 + k)}"))
    return items, rows + [(100 + k, prose(100, 800 + k)) for k in range(10)]


def test_against_full_alignment(spark, docs, cases):
    items, rows = cases
    found = decontam.matches(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    index = decontam.build_index(items)
    want = {}
    for doc_id, text in rows:
        for k, (item_id, item) in enumerate(items):
            distance = brute.edit_distance_inside(fold(item), fold(text))
            if distance <= index.edits[k]:
                want[doc_id, item_id] = distance
    assert {(r.doc_id, r.item): r.distance for r in found} == want
    assert len(want) > 30 and max(want.values()) > 5
    text_of, item_of = dict(rows), dict(items)
    for r in found:
        span = text_of[r.doc_id][r.start : r.end]
        assert brute.edit_distance_inside(fold(item_of[r.item]), fold(span)) == r.distance


def test_benchmark_in_blocks(spark, docs, cases, monkeypatch):
    items, rows = cases
    whole = decontam.matches(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    parts = decontam.matches(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(parts) == sorted(whole)
    kept = decontam.without_matches(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows} - {r.doc_id for r in whole}


def test_banded_distance_equals_the_whole_table():
    maker = random.Random(2)
    for _ in range(40):
        item = "".join(maker.choices("ab c", k=30))
        text = "".join(maker.choices("ab c", k=20)) + edited(item, 3, maker.random()) + "abc"
        codes = lambda s: np.array([ord(c) for c in s])
        distance, start, end = decontam.banded_distance(codes(item), codes(text), 12, 0, 40)
        want = brute.edit_distance_inside(item, text)
        assert min(distance, 13) == min(want, 13)
        if distance <= 12:
            assert brute.edit_distance_inside(item, text[start:end]) == distance


def test_odd_texts_and_items(spark, docs, odd, prose):
    item = prose(30, 1)
    items = [(1, item), (2, None), (3, ""), (4, "short"), (None, item), (5, item)]
    benchmark = spark.createDataFrame(items, ITEMS)
    rows = [*odd, (1000, f"x {item} y"), (1001, f"x {item} y"), (1001, f"x {item} y")]
    found = decontam.matches(docs(rows), benchmark).collect()
    want = [(d, i) for d in (1000, 1001, 1001) for i in (None, 1, 5)]
    assert sorted(((r.doc_id, r.item) for r in found), key=str) == sorted(want, key=str)
    kept = decontam.without_matches(docs(rows), benchmark)
    assert kept.count() == len(odd)


def test_items_of_any_length_against_full_alignment(spark, docs):
    """Also shorter than a q-gram, and at lengths where one more edit leaves no q-gram of 12."""
    maker = random.Random(4)
    words = lambda n: "".join(maker.choices("abcdefgh ", k=n)).strip().replace("  ", " a") or "a"
    items = [(n, words(n)) for n in [*range(1, 26), 33, 34, 35, 36, 40, 51]]
    rows = []
    for k, (n, text) in enumerate(items):
        for edits in range(int(0.06 * n) + 2):
            part = edited(text, edits, 100 * k + edits)
            rows.append((1000 * k + edits, f"{words(30)} {part} {words(30)}"))
    found = decontam.matches(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    want = {
        (doc_id, item_id): distance
        for doc_id, text in rows
        for item_id, item in items
        if (distance := brute.edit_distance_inside(fold(item), fold(text))) <= int(0.06 * len(fold(item)))
    }
    assert {(r.doc_id, r.item): r.distance for r in found} == want
    assert {18, 20, 23, 34, 35} <= {item for (_, item), d in want.items() if d}


def test_counting_in_pieces_changes_nothing(prose, monkeypatch):
    items = [(i, "na " * (13 + i)) for i in range(5)] + [(9, prose(30, 1)), (10, "na " * 14)]
    texts = ["na " * 60 + prose(20, 2), prose(30, 1), "ba na " * 40 + prose(30, 1), "na " * 14, ""]
    (index,) = decontam.build_indexes(items)
    assert index.ids == [[0], [1, 10], [2], [3], [4], [9]]
    want = decontam.search(index, texts)
    assert want
    for limit in (1, 40, 3000):
        monkeypatch.setattr(decontam, "HITS", limit)
        assert decontam.search(index, texts) == want


def test_repeated_words_take_bounded_memory():
    """A long text and a thousand items of the same few words, in a process of its own."""
    script = """
import resource
from ratewright.llm import decontam
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
items = [(i, "word " * (40 + i % 16)) for i in range(1000)]
(index,) = decontam.build_indexes(items)
found = decontam.search(index, ["word " * 30000])
assert {x[3] for x in found} == {0} and len(found) == 16, found
print("MB", (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    root = Path(decontam.__file__).resolve().parents[2]
    done = subprocess.run(
        [sys.executable, "-c", script], capture_output=True, text=True, timeout=300,
        env=os.environ | {"PYTHONPATH": str(root)},
    )
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[1]) < 500


def test_ids_of_other_types_and_no_id(spark, docs, prose):
    rows = [(1, prose(30, 1))]
    for kind, value, want in (("string", "x", "x"), ("int", 3, 3), ("double", 1.5, "1.5"), ("bigint", None, None)):
        benchmark = spark.createDataFrame([(value, prose(30, 1))], f"item_id {kind}, text string")
        assert [r.item for r in decontam.matches(docs(rows), benchmark).collect()] == [want]


def test_empty_tables_and_clashing_columns(spark, docs, clashing, prose):
    benchmark = spark.createDataFrame([(1, prose(30, 1))], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    rows = [(1, prose(30, 1)), (2, prose(30, 2))]
    assert decontam.matches(docs([]), benchmark).count() == 0
    assert decontam.matches(docs(rows), none).count() == 0
    assert decontam.without_matches(docs(rows), none).count() == 2
    assert [r.doc_id for r in decontam.matches(clashing(rows), benchmark).collect()] == [1]
    kept = decontam.without_matches(clashing(rows), benchmark)
    assert kept.columns == clashing(rows).columns and [r.doc_id for r in kept.collect()] == [2]


def test_query_finds_whole_passages(spark, sf_dir):
    from ratewright.llm.queries import op2_decontamination

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    planted = {r.doc_id for r in docs if any(i.text in (r.text or "") for i in items)}
    found = {r.doc_id for r in op2_decontamination(spark, sf_dir).collect()}
    assert planted and planted <= found
