from __future__ import annotations

import zlib

import numpy as np
import pytest

from ratewright.llm import langid


def test_folding():
    codes, owner = langid.folded(["Aé 12,b", None, "\0x"])
    assert "".join(map(chr, codes)) == "\0 aé b \0 \0 x "
    assert owner.tolist() == [0] * 7 + [1] * 2 + [2] * 4


def test_grams_stay_within_texts():
    both, owner = langid.grams(*langid.folded(["abc", "cab"]))
    alone = [langid.grams(*langid.folded([t]))[0] for t in ("abc", "cab")]
    for k in range(2):
        assert sorted(both[owner == k].tolist()) == sorted(alone[k].tolist())


def test_masks_hold_every_learned_gram(docs, prose):
    rows = [(i, f"{prose(40, i)}", f"l{i % 11}") for i in range(120)]
    model = langid.learn(docs(rows), min_share=0.0)
    assert model.languages == sorted({f"l{k}" for k in range(11)})
    assert model.masks.shape == (langid.SLOTS, 2)
    for lang in model.languages:
        frequency = {}
        for _, text, own in rows:
            if own == lang:
                for g in set(langid.grams(*langid.folded([text]))[0].tolist()):
                    frequency[g] = frequency.get(g, 0) + 1
        shared = np.array([g for g, n in frequency.items() if n >= 2], np.uint64)
        assert model.contained(shared)[:, model.languages.index(lang)].all()


def test_false_positives_are_as_rare_as_stated(docs, prose):
    rows = [(i, prose(60, i, words=3000), "xx") for i in range(400)]
    model = langid.learn(docs(rows), min_share=0.0)
    random = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    seen = model.contained(random).mean()
    assert abs(seen - model.false_positives[0]) < 0.005


def test_odd_texts_and_no_labels(docs, odd, clashing):
    rows = [(1000 + i, t, "en") for i, t in enumerate(["the cat", "the dog", "a the"])]
    model = langid.learn(docs([*rows, (2000, None, "de"), (2001, "x", None)]))
    found = langid.identify(docs(odd), model).collect()
    assert len(found) == len(odd)
    by_id = {r.doc_id: r for r in found}
    for i, text, *_ in odd:
        letters = any(c.isalpha() for c in text or "")
        if i is not None:
            assert (by_id[i].lang_pred == "und") == (not letters)
            assert 0 <= by_id[i].score <= 1
    none = langid.learn(docs([]))
    assert {r.lang_pred for r in langid.identify(docs(odd), none).collect()} == {"und"}
    assert langid.identify(docs([]), model).count() == 0
    carried = langid.identify(clashing(rows), model, carry=("doc_id", "t", "c0", "score")[:3])
    assert carried.columns == ["doc_id", "t", "c0", "lang_pred", "score"]


def test_held_out_accuracy(spark, sf_dir):
    from ratewright.llm.queries import op7_language

    big = sf_dir.replace("0.001", "0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    found = op7_language(spark, big).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def plain_grams(text):
    """All n-grams with a letter of the folded text, one by one."""
    import re

    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    padded = " " + re.sub(" +", " ", kept.strip(" ")) + " "
    padded = re.sub(" +", " ", padded)
    return [padded[i : i + n] for n in langid.GRAMS for i in range(len(padded) - n + 1) if padded[i : i + n].strip(" ")]


def plain_answers(learned, texts):
    """[(language, score)] from sets of n-grams, without filters."""
    from collections import Counter, defaultdict

    counts, docs = defaultdict(Counter), Counter()
    for lang, text in learned:
        if lang is not None and text is not None:
            counts[lang].update(set(plain_grams(text)))
            docs[lang] += 1
    own = {
        x: {g for g, n in counts[x].items() if n >= max(2.0, langid.MIN_SHARE * docs[x])} for x in sorted(counts)
    }
    out = []
    for text in texts:
        found = plain_grams(text or "")
        if not found:
            out.append(("und", 0.0, 0.0))
            continue
        shares = sorted(((sum(g in s for g in found) / len(found), x) for x, s in own.items()), key=lambda v: -v[0])
        lead = shares[0][0] - (shares[1][0] if len(shares) > 1 else 0.0)
        out.append((shares[0][1], shares[0][0], lead))
    return out


def test_query_against_plain_sets(spark, sf_dir):
    """The filters err by their false positives only, which the counts are corrected for."""
    import zlib

    from ratewright.llm.queries import op7_language

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    want = plain_answers([(r.lang, r.text) for r in rows if not held[r.doc_id]], [r.text for r in rows])
    found = {r.doc_id: r for r in op7_language(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r, (lang, score, lead) in zip(rows, want, strict=True):
        got = found[r.doc_id]
        assert got.held_out == held[r.doc_id]
        assert abs(got.score - score) < 0.02
        if lead > 0.02:
            assert got.lang_pred == lang
    assert sum(lead > 0.02 for *_, lead in want) > 0.9 * len(rows)


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 17])
def test_parts_of_a_long_text_hold_its_grams(chunk, monkeypatch, prose):
    texts = [prose(9, 1), "a", None, " ,b  c1\0d -- ", "....", "", "\U00010400\U00010401 x. y", "é" * 9, ", , a"]
    want = [sorted(langid.grams(*langid.folded([t]))[0].tolist()) for t in texts]
    monkeypatch.setattr(langid, "CHUNK_CHARS", chunk)
    found = [[] for _ in texts]
    for hashes, owner in langid.gram_parts(texts):
        for h, i in zip(hashes.tolist(), owner.tolist(), strict=True):
            found[i].append(h)
    assert [sorted(x) for x in found] == want


def test_memory_of_a_long_text(docs, prose):
    """20 million characters of one text, beside the text itself."""
    import tracemalloc

    model = langid.learn(docs([(i, prose(40, i), "en") for i in range(20)]))
    text = prose(1000, 5) * 4000
    text = text[:20_000_000]
    assert len(text) == 20_000_000
    tracemalloc.start()
    (name,), (score,) = model.decide([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert name == "en" and score > 0.5
    assert peak < 300e6
