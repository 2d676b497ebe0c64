"""Near-duplicate texts and vectors against brute force; components of graphs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm import hnsw_dedup, minhash_dedup
from cohortry.llm.common import Scratch
from cohortry.llm.components import connected_components


def union(nodes, links):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*[words[k:] for k in range(5)]))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, union(sets, links)


def agrees(spark, documents, rows):
    sets, wanted = brute(rows)
    found = minhash_dedup.near_duplicates(documents(*rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(sets[i]), wanted[i]) for i in sets}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return words


def test_near_duplicates_agree_with_brute_force(spark, documents):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 20, 90, 300]))]
        for k in (0, 0, 1, 1, 2, 3, 5, 8):
            rows.append(" ".join(edited(rng, base, k)))
    chain = [f"c{i}" for i in range(200)]
    rows += [" ".join(chain[i:i + 120]) for i in range(0, 60, 4)]
    rows += [None, "", "  \n", "One two", "one TWO", "one two three four", "ÀB c d e f", "àB c d e f", "a\x85b c d e"]
    rng.shuffle(rows)
    agrees(spark, documents, list(enumerate(rows)))


@pytest.mark.parametrize("block", [3, 1000])
def test_large_divided_clusters(spark, documents, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "CLUSTER_BLOCK", block)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    agrees(spark, documents, [(i, " ".join(edited(rng, base, rng.randrange(9)))) for i in range(70)])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, wanted = brute(rows)
    found = minhash_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_repeated_rows_and_missing_ids(documents):
    found = minhash_dedup.near_duplicates(documents((4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (9, None))).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in found) == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]
    assert minhash_dedup.near_duplicates(documents()).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    rows = links + [(b, a) for a, b in links[:30]] + [(7, 7)]
    edges = spark.createDataFrame(pa.table({"a": pa.array([a for a, _ in rows] + [None], pa.int64()), "b": pa.array([b for _, b in rows] + [3], pa.int64())}))
    found = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark)).collect()}
    nodes = {n for pair in rows for n in pair}
    assert found == union(nodes, links)
    assert connected_components(edges.limit(0), Scratch(spark)).collect() == []


def vectors(spark, rows):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("shard", pa.string())])
    return spark.createDataFrame(pa.Table.from_pylist([{"vec_id": i, "embedding": v, "label": 0, "shard": "own"} for i, v in rows], schema=schema))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for size in (1, 1, 2, 5, 30, 90):
        for _ in range(6 if size < 30 else 1):
            centre = rng.standard_normal(24)
            rows += [centre + 0.2 * rng.standard_normal(24) for _ in range(size)]
    rows += [rows[-1]] * 20
    rows = [np.asarray(v, np.float32).tolist() for v in rows]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0, 0.0], [2.0, 0.0], [float("inf")] + [1.0] * 23]
    table = list(enumerate(rows)) + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0])]
    exact = np.array(rows, np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    near = exact @ exact.T >= 0.9
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near))]
    wanted = union(range(len(rows)), links) | {1005: 1005, 1006: 1005}
    counts = dict(enumerate(near.sum(axis=1).tolist())) | {1005: 1, 1006: 1}
    found = {r["vec_id"]: r for r in hnsw_dedup.embedding_duplicates(vectors(spark, table)).collect()}
    assert len(found) == len(table)
    for i, r in found.items():
        if i is not None:
            assert r["component_id"] == wanted.get(i, i) and r["kept"] == (wanted.get(i, i) == i)
    have, want = sum(r["n_links"] for i, r in found.items() if i is not None), sum(counts.values())
    assert 0.95 * want <= have <= want and found[None]["n_links"] == 0 and found[None]["kept"]
    assert hnsw_dedup.embedding_duplicates(vectors(spark, [])).collect() == []


def test_beams_widen_until_audits_pass():
    rng = np.random.default_rng(4)
    exact = rng.standard_normal((600, 16)) * 0.25 + rng.standard_normal((3, 16))[rng.integers(0, 3, 600)]
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph(exact.astype(np.float32))
    have = want = 0
    for q, near in hnsw_dedup.neighbours(graph, exact, exact[:200], 0.9):
        truth = np.flatnonzero(exact @ exact[q] >= 0.9)
        assert set(near) <= set(truth)
        have, want = have + len(near), want + len(truth)
    assert want > 5000 and have >= 0.97 * want


@pytest.mark.parametrize("hot", [0, 700])
def test_links_into_cut_off_nodes_are_found(hot):
    rng = np.random.default_rng(6)
    exact = rng.standard_normal((2100, 24))
    exact[:hot] = rng.standard_normal(24) + 0.05 * rng.standard_normal((hot, 24))
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph(exact.astype(np.float32))
    # Nodes that no link reaches.
    lost = np.flatnonzero(graph.order >= 1400)[graph.order[graph.order >= 1400] % 2 == 1]
    for links in graph.layers:
        links[np.isin(links, lost)] = -1
    queries = rng.standard_normal((480, 24))
    # Every tenth query is audited: one other has a link, and hot members bring many.
    queries[::10][:hot // 50] = exact[:hot:50][:48]
    queries[3] = exact[1401]
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    found = dict(hnsw_dedup.neighbours(graph, exact, queries, 0.9))
    for q, query in enumerate(queries):
        assert set(found[q]) == set(np.flatnonzero(exact @ query >= 0.9))
    assert set(found[3]) == {1401}


def test_an_audit_without_links_proves_nothing():
    none, one = np.zeros(0, np.int64), np.array([1])
    assert not hnsw_dedup.audit_passes([none], [none])
    many = np.arange(1000)
    assert not hnsw_dedup.audit_passes([many] * 20 + [none], [many] * 20 + [one])


def test_graphs_are_moved_in_pieces(spark, monkeypatch):
    # Long vectors: a shard's graph has more than a megabyte, which no row may hold as a whole.
    rng = np.random.default_rng(8)
    exact = rng.standard_normal((1200, 768))
    exact[1000:] = exact[:200] + 0.2 * rng.standard_normal((200, 768))
    table = [(i, v.tolist()) for i, v in enumerate(exact)] + [(2000 + i, v) for i, v in enumerate(([1.0, 0.0], [3.0, 0.0], [0.0, 1.0]))]
    cells = []

    def store(self, df, kept=Scratch.store):
        stored = kept(self, df)
        cells.extend(r[0] for name, kind in stored.dtypes if kind == "binary" for r in stored.selectExpr(f"length({name})").collect())
        return stored

    monkeypatch.setattr(Scratch, "store", store)
    monkeypatch.setattr(hnsw_dedup, "SLOT_ROWS", 500, raising=False)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw_dedup.embedding_duplicates(vectors(spark, table)).collect()}
    exact = exact.astype(np.float32).astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    near = exact @ exact.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() == 400 and len(cells) > 8 and max(cells) <= 1 << 20
    wanted = {i: (int(n.sum()), min(i, *np.flatnonzero(n))) if n.any() else (0, i) for i, n in enumerate(near)}
    assert found == wanted | {2000: (1, 2000), 2001: (1, 2000), 2002: (0, 2002)}


def test_shards_are_bounded_in_bytes():
    laid = hnsw_dedup.layout({64: 700_000, 4096: 50_000, 2: 5})
    assert [(d, shards) for d, shards, *_ in laid] == [(2, 8), (64, 8), (4096, 25)]
    # No shard and no cell has the number of another.
    assert [x[3:] for x in laid] == [(0, 0), (8, 8), (16, 8 + 8 * 7)] and laid[2][2] == 25
