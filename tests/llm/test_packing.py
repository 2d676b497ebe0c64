"""Packing: every id lies in one piece, sequences are gapless, little is wasted."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortry.llm import packing
from cohortry.llm.common import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    texts = ["", "Hello, World's  end.\n\nÉtat\x0bdes choses\x1c x", "Straße <|endoftext|> İstanbul Σίσυφος ΟΔΟΣ", "<|ENDOFTEXT|>a", "naïve\xa0cafe\x85y",
             "é ́x 漢字かな", "don't DON'T 12345 ...!!", "µ ÿ Ÿ"]
    words = packing.WordTokenizer(PATH)
    for _ in range(2):
        assert [i.tolist() for i in words.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    words = packing._tokenizer(PATH)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [i.tolist() for i in words.ids(texts)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def plain_best_fit(lengths, window):
    """Best-fit decreasing by looking at all open windows."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(window - length)
    return len(free), sorted(free)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    lengths = np.array(lengths, np.int64)
    place, offset = packing.best_fit_decreasing(lengths, 64)
    used = defaultdict(list)
    for p, o, n in zip(place, offset, lengths):
        used[int(p)].append((int(o), int(n)))
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    if len(lengths):
        assert plain_best_fit(lengths.tolist(), 64) == (len(used), sorted(64 - sum(n for _, n in p) for p in used.values()))


def test_no_id_or_text_makes_a_large_group(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rows = [(1, f"text number {i}") for i in range(400)] + [(None, f"no id {i}") for i in range(300)] + [(7, "the same row")] * 300 + [(2**60 + 1, "large id")]
    pieces = packing.cut_documents(documents(*rows), emit=["ids_crc32"])
    packed = packing.pack_pieces(pieces, Scratch(spark)).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in packed) == Counter((r["doc_id"], r["ids_crc32"]) for r in pieces.collect())
    groups = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(groups) == -(-1001 // 50) and max(groups.values()) < 100
    assert sorted(map(tuple, packed), key=str) == sorted(map(tuple, packing.pack_pieces(pieces.repartition(7), Scratch(spark)).collect()), key=str)


def test_documents_round_trip(spark, documents, tokenizer):
    long = "word by word " * 4000
    docs = documents((1, "a short text"), (2, None), (3, ""), (4, long), (1, "a short text"), (None, "no id"), (5, "x"))
    packed = packing.pack_pieces(packing.cut_documents(docs, emit=["ids", "ids_crc32"]), Scratch(spark)).collect()
    whole = tokenizer.encode(long, add_special_tokens=False).ids + [2]
    mine = sorted((r for r in packed if r["doc_id"] == 4), key=lambda r: r["start"])
    assert [i for r in mine for i in r["ids"]] == whole and len(mine) == -(-len(whole) // 4096)
    assert all(r["doc_tokens"] == len(whole) for r in mine)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in packed)
    assert [r["ids"] for r in packed if r["doc_id"] == 2] == [[2]] and len([r for r in packed if r["doc_id"] == 1]) == 2
    ends = defaultdict(list)
    for r in packed:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in ends.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 4096
    assert packing.pack_pieces(packing.cut_documents(docs.limit(0)), Scratch(spark)).collect() == []
