"""Ids by distinct marked words against the library on whole texts."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm.piece_chunks import MARKER, encode_block, encode_documents, decode_ids, marked_words, separable

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
ALL = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
ODD = [
    "", " ", "  ", "a", " a", "a ", "  a  b  ", "\n\n a\t b\n", "x" * 5000, " " * 700, "word " * 3000, f"{MARKER}a{MARKER}{MARKER}b {MARKER}", MARKER, f"a{MARKER} ",
    "<s> </s> <unk> <0x0A>", "\x00 a\x00b", "日本語 テキスト 🙂🙂", "é ﬁ ①", "  　x", "12 345  6", "� ", "𝔘𝔫𝔦 " * 20,
]


def whole(text):
    ids = MODEL.encode(text or "", add_eos=True)
    decoded = MODEL.decode(ids)
    return (ids, decoded, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def by_block(texts, **how):
    out = encode_block(MODEL, pa.array(texts, pa.string()), ALL, **how)
    return list(zip(*[out[c].to_pylist() for c in ALL]))


def test_the_model_is_separable():
    assert separable(MODEL)


def test_odd_texts_and_nulls():
    texts = ODD + [None] + ODD[::-1]
    assert by_block(texts) == [whole(t) for t in texts]
    assert by_block(texts, whole=True) == [whole(t) for t in texts]
    assert by_block([]) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(f"  {MARKER}ab\n<>é"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_any_texts(texts):
    assert by_block(texts) == [whole(t) for t in texts]


def test_words_cover_the_texts():
    words, first = marked_words(pa.array(["a  b", None, "", f"{MARKER}c d", " e "]))
    assert words.to_pylist() == [" a", "  b", f" {MARKER}c", " d", "  e", " "]
    assert first.tolist() == [0, 2, 2, 2, 4, 6]


def test_each_distinct_word_is_segmented_once():
    class Counting:
        seen: list = []

        def __getattr__(self, name):
            return getattr(MODEL, name)

        def encode(self, texts, **how):
            self.seen.extend(texts)
            return MODEL.encode(texts, **how)

    model = Counting()
    encode_block(model, pa.array(["one two one", "two  two one"] * 50), ["ids"])
    assert sorted(model.seen) == [" two", "one", "two"]


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_documents_in_any_blocks(spark, documents, block):
    docs = documents(*[(i, t) for i, t in enumerate(ODD)], (None, None), (3, "same id"), (3, "same id")).withColumnRenamed("key", "ids")
    found = encode_documents(docs, PATH, ALL, block=block)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", *ALL}
    rows = found.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert tuple(r[c] if c != "ids" else list(r[c]) for c in ALL) == whole(r["text"])


def test_decoding_ids_and_empty_table(spark, documents):
    docs = documents(*[(i, t) for i, t in enumerate(ODD)])
    found = decode_ids(encode_documents(docs, PATH), PATH).collect()
    assert all(r["decoded"] == MODEL.decode(list(r["ids"])) for r in found)
    assert encode_documents(documents(), PATH, ALL).collect() == []
