"""Greedy string tiling against a plain version, and leaks of planted passages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.llm import decontamination as d


def plain_tiles(item, text, shortest):
    """Longest common runs of unmarked tokens, taken from left to right, again and again."""
    here, there, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best, found = shortest, []
        for j in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not here[i + n] and not there[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(here[i:i + best]) and not any(there[j:j + best]):
                here[i:i + best] = [True] * best
                there[j:j + best] = [True] * best
                tiles.append((i, j, best))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40), st.integers(1, 4))
def test_tiles(item, text, shortest):
    found = d.greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), shortest)
    assert sorted(found) == sorted(plain_tiles(item, text, shortest))


def test_leaks(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = [word() for _ in range(40)]
    fill = lambda n: [word() for _ in range(n)]
    texts = {
        1: fill(300), 2: fill(100) + item + fill(100), 3: fill(50) + item[20:] + fill(30) + item[:20] + fill(9), 4: fill(60) + item[:12] + fill(60),
        5: fill(10) + [w.upper() + "," for w in item], 6: item, 7: fill(20_000) + item, 8: [w for pair in zip(item, fill(40)) for w in pair]}
    docs = documents(*[(k, " ".join(v)) for k, v in texts.items()], (9, None), (10, ""), (2, " ".join(texts[2])), (11, "tiny Test, here"), (12, "this tiny test. No"))
    bench = spark.createDataFrame(pa.table({"item_id": pa.array([7, 8, 9, 10], pa.int64()), "text": [" ".join(item), None, "...", "tiny test"]}))
    found = docs.select("doc_id", F.inline(d.leaked_items(bench, F.col("text")))).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(2, 7), (2, 7), (3, 7), (5, 7), (6, 7), (7, 7), (11, 10), (12, 10)]
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[3]["coverage"] == 1.0 and by_id[3]["tiles"] == 2 and by_id[2]["tiles"] == 1
    assert docs.select(d.leaked_items(bench.limit(0), F.col("text")).alias("x")).where("size(x) > 0").count() == 0
    assert docs.limit(0).select(d.leaked_items(bench, F.col("text"))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=40), min_size=1, max_size=4), st.lists(st.integers(0, 2), max_size=60))
def test_repetitive_items_leak_as_plain_tiling_says(items, text):
    word = lambda v: " ".join("abc"[k] for k in v)
    hashes = lambda v: d.word_hashes(*d.text_buffer(pa.array([word(v)], pa.large_string())), d._GAP)[0]
    found = d.leaks(hashes(text), d.build_index([(i, word(v)) for i, v in enumerate(items)]), d.COVERAGE)
    shares = {i: sum(t[2] for t in plain_tiles(v, text, min(d.TILE, len(v)))) / len(v) for i, v in enumerate(items)}
    assert {i: c for i, c, _ in found} == {i: c for i, c in shares.items() if c >= d.COVERAGE}


def test_items_of_repeated_words_leak(spark, documents):
    items = ["ho " * 12, "row row the boat " * 11, "one two three four five " * 2 + " ".join(f"x{i}" for i in range(20)) + " six seven eight nine ten y1 y2 y3 y4 y5"]
    chopped = "one two three four five z one two three four five z x0 x1 x2 x3 x4 z six seven eight nine ten"
    docs = documents((1, "start " + items[0]), (2, items[1] + " end"), (3, chopped), (4, "ho ho ho row row"))
    bench = spark.createDataFrame(pa.table({"item_id": pa.array([1, 2, 3], pa.int64()), "text": items}))
    found = docs.select("doc_id", F.inline(d.leaked_items(bench, F.col("text")))).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in found) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.5)]


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda: sorted(map(tuple, docs.select("doc_id", F.inline(d.leaked_items(bench, F.col("text")))).collect()))
    whole = rows()
    monkeypatch.setattr(d, "BLOCK_WORDS", 500)
    assert rows() == whole and whole
