"""Hard negatives against brute force in Python integers."""

import math

import numpy as np
import pytest

from vigil.llm import negatives


def _brute(rows, positives=5, k=5):
    """rows: (vec_id, label, vector)."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    out = []
    for i, lab, a in {(i, lab, tuple(v)): None for i, lab, v in good if i % 100 == 0}:
        others = sorted((-dot(a, v), j, m) for j, m, v in good if len(v) == len(a))
        for neg, j, _ in [x for x in others if x[2] == lab and x[1] != i][:positives]:
            near = [(-s, n) for s, n, m in others if m != lab and 80 * -neg <= 100 * -s <= 100 * -neg][:k]
            out += [(i, j, r + 1, n, -neg, s) for r, (s, n) in enumerate(near)]
    return sorted(out)


def _rows(n=900, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 2, size=(n, 1))
    x[100:160] = x[0]                       # copies of an anchor
    x[200:300] = x[301]                     # copies that are anchors and others
    x[400] = 0
    x[500] = -x[501]
    rows = [(i, int(rng.integers(0, 4)), [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, [1.0] * dim), (n, None, [1.0] * dim), (n + 1, 1, None), (1000, 1, [nan] * dim), (n + 3, 1, [inf] * dim),
             (n + 4, 1, [None] * dim), (2000, 1, []), (2001, 1, []), (2002, 2, []), (3000, 1, [1.0, 2.0]), (3001, 1, [1.0, 2.0]),
             (3002, 3, [1.0, 1.75]), rows[600], rows[600], rows[17], (700, 2, [0.5] * dim), (-100, 2, [0.25] * dim)]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_mining_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", (60, 32_768))
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label int, embedding array<{kind}>, theta string, block int")
    got = sorted(tuple(r) for r in negatives.mine(df).collect())
    assert got == _brute(rows)
    assert negatives.mine(df.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(100 * i, i % 2, [2.0 ** 40 + i, float(i)]) for i in range(4)] + [(i, i % 2, [2.0 ** 30 * i, 3.0]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    cut = lambda s: max(min(s, (1 << 63) - 1), -(1 << 63))
    got = {tuple(r)[:4] for r in negatives.mine(df).collect()}
    want = [r for r in _brute(rows) if cut(r[4]) == r[4]]
    assert {r[:4] for r in want} <= got


def test_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 6))
    b = negatives.Bucket(np.arange(2000), np.zeros(2000, np.int64), list(x / np.linalg.norm(x, axis=1, keepdims=True)))
    left = []
    for i in range(50):
        a = b.x[i]
        s = b.x @ a
        theta = float(np.sort(s)[-6])
        rows = b.candidates(a, theta)
        assert set(np.flatnonzero(s >= theta)) <= set(rows.tolist())
        left.append(len(rows))
    assert np.mean(left) < 400
