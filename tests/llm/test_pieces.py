from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from ratewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.codec(PATH)
PARTS = ["a", "word", " ", "  ", "\n", "\t", "\0", "é", "é", "ﬁ", "①", "中", "👍🏽", "▁", "▁▁", "<s>", "</s>", "<unk>",
         "<0x0A>", "　", "\xa0", "​", "Å", "ｱﾞ", "　", "x" * 70, "�", "\r\n", "12", "!?"]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40)


def changed(**fields) -> bytes:
    """The model with another normaliser specification."""
    with open(PATH, "rb") as f:
        model = f.read()
    extra = sentencepiece_model_pb2.ModelProto()
    for name, value in fields.items():
        part = extra.trainer_spec if name == "treat_whitespace_as_suffix" else extra.normalizer_spec
        setattr(part, name, value)
    return model + extra.SerializeToString()


def compiled(rule: str) -> bytes:
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(normaliser.serialized_normalizer_spec())
    return spec.precompiled_charsmap


def agree(own: pieces.Codec, library, text: bytes) -> None:
    want = library.encode(text, return_type="proto").pieces
    found = own.encode(text)
    assert found.ids.tolist() == [p.id for p in want]
    assert found.begin.tolist() == [p.begin for p in want]
    assert found.end.tolist() == [p.end for p in want]
    ids = found.ids.tolist()
    assert own.decode(found.ids) == library.decode(ids)
    ids = [library.bos_id(), *ids, library.eos_id()]
    assert own.decode(np.array(ids)) == library.decode(ids)


@given(texts)
@settings(max_examples=800, deadline=None)
def test_ids_spans_and_text_are_the_librarys(text):
    agree(CODEC, LIBRARY, text.encode())


@given(st.lists(st.sampled_from([b"\xff", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xf0\x9f", b"a", b" ", b"\xc0\x80", "é".encode()]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_bytes_that_are_not_utf8(parts):
    agree(CODEC, LIBRARY, b"".join(parts))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("behind", [True, False])
def test_models_with_a_character_map(rule, trim, behind):
    model = changed(
        precompiled_charsmap=compiled(rule), remove_extra_whitespaces=trim, treat_whitespace_as_suffix=behind
    )
    own, library = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)

    @given(texts)
    @settings(max_examples=250, deadline=None)
    def check(text):
        agree(own, library, text.encode())

    check()


@given(st.lists(st.integers(0, 31_999) | st.integers(0, 260), max_size=20))
@settings(max_examples=500, deadline=None)
def test_any_ids_decode_like_the_librarys(ids):
    assert CODEC.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("ids", [[197, 1, 131], [197, 131], [198, 172, 2, 131], [1, 197, 131, 2], [197, 1, 1, 300, 131]])
def test_bytes_beside_a_control_piece(ids):
    assert CODEC.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_no_prefix_and_no_escape():
    for fields in ({"add_dummy_prefix": False}, {"escape_whitespaces": False}, {"remove_extra_whitespaces": True}):
        model = changed(**fields)
        own, library = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for text in ("", " ", "  a  b ", "a b", "▁x  ", "\n a"):
            agree(own, library, text.encode())


def test_blocks_and_memory_limits_change_nothing(monkeypatch, prose):
    text = (prose(2000, 3) + "  " + "y" * 500 + " ▁▁ " + "é" * 300).encode()
    want = CODEC.encode(text)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 13)
    monkeypatch.setattr(pieces, "REMEMBERED_PARTS", 5)
    monkeypatch.setattr(pieces, "LONGEST_REMEMBERED", 3)
    own = pieces.Codec(changed())
    for a, b in zip(own.encode(text), want, strict=True):
        assert a.tolist() == b.tolist()


def test_spans_cover_the_source():
    text = "Hé  llo\n👍🏽 wörld"
    found = CODEC.encode(text.encode())
    shown = [text.encode()[b:e] for b, e in zip(found.begin, found.end, strict=True)]
    assert b"".join(shown) == text.encode()


def want(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids), len((text or "").encode())


def test_rows(docs, odd, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_BYTES", 20)
    found = pieces.encode(docs([r[:2] for r in odd]), PATH).collect()
    key = lambda r: str((r[0], r[1]))
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded, r.covered) for r in found), key=key) == sorted(
        ((i, *want(t)) for i, t, *_ in odd), key=key
    )
    for r in found:
        assert len(r.begins) == len(r.ends) == len(r.ids) // 4 - 2


def test_empty_table_and_clashing_columns(docs, clashing):
    assert pieces.encode(docs([]), PATH).collect() == []
    (row,) = pieces.encode(clashing([(1, "a b")]), PATH, begin=False, end=False, spans=False).collect()
    assert (row.doc_id, bytes(row.ids)) == (1, np.array(LIBRARY.encode("a b"), "<u4").tobytes())


def test_a_very_long_text(spark):
    text = "ab cd " * 400_000 + "z" * 20_000
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = pieces.encode(frame, PATH, spans=False).collect()
    assert (bytes(row.ids), row.decoded, row.covered) == want(text)


def test_query(spark, sf_dir):
    from ratewright.llm.queries import op11_pieces

    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for r in rows:
        ids, decoded, size = want(r.text)
        expected[r.doc_id] = (len(ids) // 4, sha(ids), sha(decoded.encode()), size)
    found = op11_pieces(spark, sf_dir).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: tuple(r)[1:5] for r in found} == expected
