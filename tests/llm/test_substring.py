from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from ratewright.llm import substring


def result(frame, **options):
    found = substring.dedup_substrings(frame, digest=True, **options)
    rows = found.select("row.doc_id", "n_words", "n_removed", "kept").collect()
    return sorted(map(tuple, rows), key=str)


def check(docs, rows, window=35, **options):
    want = sorted(brute.substrings([r[:2] for r in rows], window), key=str)
    assert result(docs(rows), window=window, **options) == want
    return sum(r[2] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_against_every_window(docs, prose, seed):
    maker = random.Random(seed)
    shared = [prose(n, 100 + i) for i, n in enumerate((34, 35, 36, 50, 120))]
    rows = []
    for i in range(80):
        parts = [prose(maker.randint(0, 90), 1000 * seed + i)]
        for _ in range(maker.randint(0, 3)):
            words = maker.choice(shared).split()
            if maker.random() < 0.5:
                words[maker.randrange(len(words))] = "edited"
            parts += [" ".join(words), prose(maker.randint(0, 40), maker.random())]
        rows.append((i, maker.choice(["\n", "  ", " "]).join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    assert check(docs, rows) > 500


@pytest.mark.parametrize("words", [2, 5])
def test_few_different_words_and_self_repeats(docs, prose, words):
    rows = [(i, prose(150, i, words=words)) for i in range(20)]
    rows += [(50, "na " * 200), (51, "na " * 36), (52, "na " * 35), (53, "ba na " * 40)]
    assert check(docs, rows) > 0
    assert check(docs, rows, window=12, seed_words=4) > 0


def test_a_passage_in_every_document(docs, prose):
    passage = prose(60, 7)
    # Marked neighbours: no word around the passage can agree with that of another document.
    rows = [(i, f"{prose(20, i)} b{i} {passage} a{i} {prose(20, 500 + i)}") for i in range(150)]
    assert check(docs, rows) == 150 * 60


def test_odd_texts(docs, odd):
    check(docs, odd)


def test_empty_table_and_clashing_columns(docs, clashing, prose):
    assert result(docs([])) == []
    rows = [(1, prose(50, 1)), (2, prose(50, 1)), (3, prose(50, 2))]
    assert result(clashing(rows)) == result(docs(rows))


def test_texts_keep_their_white_space_outside_the_cut(docs, prose):
    passage = prose(40, 3)
    rows = [(1, f"one\n\ntwo {passage}\tthree  four"), (2, f"{passage}"), (3, " clean\n text ")]
    kept = {
        r.doc_id: r.kept
        for r in substring.dedup_substrings(docs(rows)).select("row.doc_id", "kept").collect()
    }
    assert kept == {1: "one\n\ntwo three  four", 2: "", 3: " clean\n text "}


def test_query_on_given_documents(spark, sf_dir):
    from ratewright.llm.queries import op5_substrings

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute.substrings([tuple(r) for r in docs]))
    assert sorted(map(tuple, op5_substrings(spark, sf_dir).collect())) == want
    assert sum(r[2] for r in want) > 0


def test_partitioning_does_not_matter(docs, prose):
    rows = [(i, prose(70, i % 30)) for i in range(60)]
    assert result(docs(rows)) == result(docs(rows).repartition(9, F.col("n_chars")))
