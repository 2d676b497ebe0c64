"""Active-entry Lloyd codes against plain Lloyd rounds in Python integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm.common import Scratch
from cohortry.llm.vector_codes import assign, code_vectors, train_codes

TABLE = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("label", pa.int32()), ("code", pa.string()), ("part", pa.int32())])


def vectors(spark, rows):
    data = [{"vec_id": r[0], "embedding": r[1], "label": r[2], "code": "x", "part": 9} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=TABLE)).repartition(3)


def plain(rows, parts=8, k=16, rounds=6, scale=4096):
    """All distances to all entries, every round, in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = [[n * scale // m for n, m in (float(x).as_integer_ratio() for x in r[1])] for r in kept]
    width = len(ints[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:k]
    book = [[cut[i][p] for i in order] for p in range(parts)]
    for turn in range(rounds + 1):
        far = [[[sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in book[p]] for p in range(parts)] for v in cut]
        codes = [[min(range(len(d)), key=lambda i: (d[i], i)) for d in v] for v in far]
        if turn == rounds:
            break
        for p in range(parts):
            for i in range(len(book[p])):
                own = [cut[n][p] for n in range(len(cut)) if codes[n][p] == i]
                if own:
                    book[p][i] = [sum(c) // len(own) for c in zip(*own)]
    error = [min(sum(d[p][c[p]] for p in range(parts)), 2**63 - 1) for d, c in zip(far, codes)]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return sorted((repr(r[0]), "".join(f"{i:02x}" for i in c), e, min(by_label[r[2]], 2**63 - 1), digest) for r, c, e in zip(kept, codes, error))


def found(spark, rows, **settings):
    out = code_vectors(vectors(spark, rows), Scratch(spark), **settings)
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect())


def cloud(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i * 3 % n, (centres[i % 6] + rng.normal(scale=spread, size=dims)).astype(np.float32).tolist(), i % 4 or None) for i in range(n)]


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.05)])
def test_agrees_with_plain_lloyd(spark, seed, spread):
    rows = cloud(240, 16, seed, spread)
    assert found(spark, rows) == plain(rows)


def test_nulls_repeats_ties_and_unusable_vectors(spark):
    rows = cloud(40, 8, 3) + [(5, [0.0] * 8, 1)] * 30 + [(None, [0.5] * 8, None), (7, None, 1), (8, [], 1), (9, [1.0] * 7 + [None], 2), (10, [float("nan")] * 8, 2), (11, [float("inf")] * 8, 2)]
    assert found(spark, rows) == plain(rows)
    few = [(2, [0.25] * 8, 1), (1, [-0.25] * 8, 1), (1, [-0.25] * 8, 1)]
    assert found(spark, few) == plain(few)


def test_integers_beyond_64_bits_stay_exact(spark):
    rows = [(i, [float(x) * 10.0 ** (i % 12) for x in np.random.default_rng(i).normal(size=8)], 0) for i in range(30)] + [(99, [1e300] * 8, 0), (98, [-1e300] * 8, 0)]
    assert found(spark, rows, parts=2, entries=4) == plain(rows, parts=2, k=4)


def test_empty_table_and_wrong_lengths(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    for rows in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)]):
        with pytest.raises(ValueError, match="components"):
            found(spark, rows)


def test_fixed_parts_meet_only_moved_entries(spark):
    rng = np.random.default_rng(4)
    ints, book = rng.integers(-50, 50, (500, 4, 3)), rng.integers(-50, 50, (4, 8, 3))
    codes, far, full = assign(ints, book, None, None, None)
    new = book.copy()
    new[:, 2] += 5
    moved = (new != book).any(axis=2)
    again, closer, some = assign(ints, new, codes, far, moved)
    want, exact, _ = assign(ints, new, None, None, None)
    assert (again == want).all() and (closer == exact).all()
    rescanned = (codes == 2).sum()
    assert full == 500 * 4 * 8 and some == rescanned * 8 + (500 * 4 - rescanned)


def test_settled_rounds_cost_little(spark):
    _, _, work = train_codes(vectors(spark, cloud(300, 16, 5, 0.0)), Scratch(spark))
    assert len(work) == 7 and work[0] == 300 * 8 * 16 and work[-1] == 0
    _, _, work = train_codes(vectors(spark, cloud(300, 16, 5, 0.1)), Scratch(spark))
    assert sorted(work, reverse=True) == work and work[-1] < 0.7 * work[0]
