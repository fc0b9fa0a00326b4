"""Texts in string columns whose bytes are not UTF-8."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ratewright.llm import chat, decontam, langid, tokens

BAD = "cast(unhex('FFC3') as string)"


@pytest.fixture
def bad_docs(docs, prose):
    """Each text twice: with bad bytes around it, and with U+FFFD in their place."""
    base = docs([(i, prose(30, i), f"l{i % 2}") for i in range(6)])
    broken = base.withColumn("text", F.concat(F.expr(BAD), F.lit(" "), "text", F.lit(" "), F.expr(BAD)))
    mended = broken.withColumns({"text": F.make_valid_utf8("text"), "doc_id": F.col("doc_id") + 100})
    return broken, mended


def same(found, columns):
    rows = {r.doc_id: tuple(r[c] for c in columns) for r in found}
    assert rows and all(rows[i] == rows[i + 100] for i in list(rows) if i < 100)
    return rows


def test_tokens(bad_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    broken, mended = bad_docs
    found = tokens.count_tokens(broken.unionByName(mended), f"{tmp_path}/c", path).collect()
    assert len(same(found, ["n_bytes", "n_tokens"])) == 12


def test_language(bad_docs):
    broken, mended = bad_docs
    both = broken.unionByName(mended)
    model = langid.learn(both)
    assert len(same(langid.identify(both, model).collect(), ["lang_pred", "score"])) == 12
    carried = langid.identify(both, model, carry=("doc_id", "text"))
    assert carried.filter("lang_pred = 'und'").count() == 0


def test_decontamination(bad_docs, prose):
    broken, mended = bad_docs
    both = broken.unionByName(mended)
    items = both.filter("doc_id = 3").select(F.col("doc_id").alias("item_id"), "text")
    found = decontam.matches(both, items).collect()
    assert sorted(r.doc_id for r in found) == [3, 103]
    assert decontam.without_matches(both, items).count() == 10


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string")
    broken = rows.withColumns({"text": F.concat("text", F.expr(BAD)), "role": F.concat("role", F.expr(BAD))})
    mended = broken.withColumns({c: F.make_valid_utf8(c) for c in ("role", "text")})
    found, want = (chat.read_back(chat.format_turns(x)).collect() for x in (broken, mended))
    assert found == want and found[0].n_turns == 2
