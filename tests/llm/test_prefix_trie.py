"""Prefix nodes by sorted LCPs against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm import prefix_trie as trie
from cohortry.llm.common import Scratch

TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("depth", pa.int64()), ("key", pa.string())])


def turns(spark, rows):
    data = [dict(zip(("conv_id", "turn", "role", "text"), r), depth=7, key="k") for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=TURNS)).repartition(3)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    """conv_id -> list of (token, words), by the contract."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, role, digest(role, text), len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    own = {c: [x[3:] for x in sorted(found)] for c, found in own.items()}
    out = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + found[h:]
    return out


def plain(sequences):
    members, ends, words = {}, {}, {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            p = tuple(t for t, _ in seq[:d])
            members.setdefault(p, []).append(c)
            words[p] = seq[d - 1][1] if d else 0
        ends.setdefault(p, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}

    def below(p):
        leaves, saved = 0 if p in kids else 1, (len(members[p]) - 1) * words[p]
        for q in kids.get(p, ()):
            below(q)
            leaves, saved = leaves + total[q][0], saved + total[q][1]
        total[p] = leaves, saved

    if members:
        below(())
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, ())), *total[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, block_turns=trie.BLOCK_TURNS):
    out = trie.prefix_trie(trie.branched(trie.sequences(turns(spark, rows))), Scratch(spark), block_turns)
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.select(*trie.RESULT).collect())


def random_rows(seed, convs, most=6, kinds=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", None, ""]), rng.choice(["a", "b  c", " d\te f ", None][:kinds + 1]))
            for c in rng.sample(range(-30, 10 * convs), convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("block_turns", [1, 7, 1 << 18])
def test_agrees_with_a_dictionary_of_prefixes(spark, block_turns):
    rows = random_rows(block_turns, 60)
    assert found(spark, rows, block_turns) == plain(rebuilt(rows))


def test_copies_nulls_ties_and_turnless(spark):
    copies = [(c, t, "u", f"same {t}") for c in range(200, 280) for t in range(3)]
    odd = [(1, None, "u", "first"), (1, None, None, "first"), (1, 2, "u", "x " * 20000), (1, 2, "u", "x " * 20000), (None, 1, "u", "nobody's"), (3, 1, None, None), (23, 0, "u", "same 0"), (40, 0, "a", "")]
    assert any(not s for s in rebuilt(odd).values())
    rows = copies + odd
    assert found(spark, rows, 20) == plain(rebuilt(rows))


def test_only_turnless_and_empty(spark):
    alone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "u", "gone") for c in alone]
    assert found(spark, rows) == plain(rebuilt(rows)) and len(found(spark, rows)) == 1
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_extents_are_what_a_walk_finds():
    rng = np.random.default_rng(1)
    lcp = rng.integers(0, 5, 300)
    place, depth = rng.integers(0, 300, 500), rng.integers(0, 6, 500)
    left, right = trie.extents(trie.sparse_table(lcp), place, depth)
    for i, d, a, b in zip(place, depth, left, right):
        x = y = i
        while x > 0 and lcp[x] >= d:
            x -= 1
        while y + 1 < 300 and lcp[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
    first = rng.integers(0, 300, 200)
    last = np.minimum(first + rng.integers(0, 300, 200), 299)
    assert trie.range_minimum(trie.sparse_table(lcp), first, last).tolist() == [lcp[a:b + 1].min() for a, b in zip(first, last)]


@pytest.mark.parametrize("seed", range(40))
def test_blocks_add_up(seed):
    """One block against the same conversations cut in two, share by share."""
    rng = random.Random(seed)
    sequences = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))), c) for c in rng.sample(range(100), rng.randint(2, 12)))
    keys = [b"".join(bytes([x]) * trie.DIGEST for x in s) for s, _ in sequences]
    cut = rng.randint(1, len(keys) - 1)

    def block(a, b, before, after):
        lengths = np.array([len(k) // trie.DIGEST for k in keys[a:b]])
        return trie.block_nodes(trie.Block(np.array([c for _, c in sequences[a:b]]), keys[a:b], lengths, np.concatenate([np.arange(n) + 1 for n in lengths]).astype(np.int64), before, after, (0, a))).to_pylist()

    between = trie._shared_turns(keys[cut - 1], keys[cut])
    halves = block(0, cut, -1, between) + block(cut, len(keys), between, -1)
    numbers = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    shares = {}
    for r in halves:
        if r["node"] is not None:
            one = shares.setdefault(r["node"], {"conv_id": r["conv_id"], "depth": r["depth"], **dict.fromkeys(numbers, 0)})
            one["conv_id"] = min(one["conv_id"], r["conv_id"])
            for c in numbers:
                one[c] += r[c]
    rows = [r for r in halves if r["node"] is None] + list(shares.values())
    pick = lambda r: (r["conv_id"], r["depth"], *[r[c] for c in numbers])
    assert sorted(map(pick, rows)) == sorted(map(pick, block(0, len(keys), -1, -1)))
