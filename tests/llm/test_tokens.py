from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratewright.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
COUNT = tokens.counter(PATH)
SPACES = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u180e", "\u200b",
          "\x1c", "\x1d", "\x1f", "\ufeff"]
PIECES = [*SPACES, "a", "word", "'s", "'", "12", "é", "中", "!?", "<|endoftext|>", "<|end", "\0", "👍🏽"]


def whole(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=40))
@settings(max_examples=1500, deadline=None)
def test_pieces_count_like_the_whole(text):
    assert COUNT([text]) == [whole(text)]


def test_white_space_before_an_added_token():
    for text in ("\n\n<|endoftext|>", "a \n\n <|endoftext|>\n\n b", "<|endoftext|>  ", "  <|endoftext|"):
        assert COUNT([text]) == [whole(text)]


def test_memory_is_bounded_and_forgets_nothing_that_counts(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_PIECES", 5)
    count = tokens.counter(PATH)
    texts = [f"w{i} x{i} {'long' * 30}{i}" for i in range(50)]
    for _ in range(2):
        for at in range(0, 50, 7):
            assert count(texts[at : at + 7]) == [whole(t) for t in texts[at : at + 7]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    texts = ["Hello  there", "", "a\n\nb <s> é", "x" * 500]
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(own.encode(t)) for t in texts]
    else:
        own = Tokenizer.from_file(path)
        want = [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens.counter(path)(texts) == want


def counts(frame, cache):
    found = tokens.count_tokens(frame, cache, PATH)
    return sorted(map(tuple, found.collect()), key=str)


def test_counts_and_cache(spark, docs, odd, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = [r[:2] for r in odd]
    want = sorted(((i, len((t or "").encode()), whole(t)) for i, t in rows), key=str)
    assert counts(docs(rows), cache) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    # Nothing is encoded twice; only new contents are added.
    more = [*rows, (5000, "something new"), (5001, "something new")]
    assert len(counts(docs(more), cache)) == len(more)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # Another tokenizer has entries of its own.
    other = public_tokenizers.path("word_bpe_49k.json")
    found = tokens.count_tokens(docs([(1, "a b")]), cache, other).collect()
    assert [tuple(r) for r in found] == [(1, 3, 2)]


def test_stored_counts_are_used(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    tokens.count_tokens(docs([(1, "one"), (2, "two")]), cache, PATH)
    fake = spark.read.parquet(cache).withColumn("n_tokens", spark.range(1).selectExpr("77L").scalar())
    fake.write.parquet(cache + "2")
    assert counts(docs([(1, "one")]), cache + "2") == [(1, 3, 77)]


def test_empty_table_and_clashing_columns(docs, clashing, tmp_path):
    assert counts(docs([]), str(tmp_path / "a")) == []
    assert counts(clashing([(1, "a b")]), str(tmp_path / "b")) == [(1, 3, 2)]


def test_query(spark, sf_dir):
    from ratewright.llm.queries import op4_tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), whole(r.text)) for r in docs}
    found = op4_tokens(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == want and len(found) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
