"""Hard negatives against a plain comparison of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterloom.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=3, k=5, m=3, window=(100, 50, 95), scale=256):
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((-(2**63) if i is None else i, [max(-(1 << 24), min(1 << 24, math.floor(scale * float(np.float32(x))))) for x in v], label, i))
    out = []
    whole, low, high = window
    for n, (_, v, label, i) in enumerate(use):
        if i is None or i % every:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=False)) for _, w, _, _ in use]
        same = sorted((-score[j], use[j][0]) for j in range(len(use)) if j != n and use[j][2] == label)[:k]
        for p, positive in same:
            other = sorted((-score[j], use[j][0]) for j in range(len(use)) if use[j][2] != label and low * -p <= whole * score[j] <= high * -p)[:m]
            out += [(i, positive, r + 1, negative, -p, -q) for r, (q, negative) in enumerate(other)]
    return [tuple(None if x == -(2**63) else x for x in r) for r in out]


def found(df, **more):
    rows = [tuple(r[x] for x in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hn.mine(df, F.col("vec_id") % 3 == 0, **more).collect()]
    return sorted(rows, key=repr)


def vectors(n, d, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, d))
    x = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, d)) * rng.choice([0.1, 1.0], (n, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(y) for y in x[i].astype(np.float32)], int(rng.integers(0, labels) ** 2 // labels)) for i in range(n)]


@pytest.mark.parametrize("d,block,tile,group", [(64, 2048, 200_000, 2_000_000), (64, 16, 20, 50), (5, 7, 9, 1000), (100, 50, 64, 100)])
def test_same_as_all_pairs(spark, monkeypatch, d, block, tile, group):
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = vectors(260, d, d + block)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # a group of equal vectors: ties
    random.Random(1).shuffle(rows)
    assert found(spark.createDataFrame(rows, VECTORS), tile=tile, group=group) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    a = [0.5, -0.25, 1.0]
    rows = [(0, a, 1), (0, a, 1), (3, a, 1), (None, a, 1), (None, [0.4, -0.2, 0.9], 2), (6, [0.4, -0.2, 0.7], 2), (9, None, 1), (12, a, None), (15, [0.1, None, 0.3], 1), (18, [0.1, float("nan"), 0.3], 1),
            (21, [0.1, float("inf"), 0.3], 1), (24, [], 1), (27, [1e30, 1.0, 1.0], 2), (30, [0.5], 2), (33, [0.0, 0.0, 0.0], 7)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS + ", key string, code string")
    assert found(df) == sorted(plain(rows), key=repr)
    assert found(spark.createDataFrame([], VECTORS)) == []


def test_bounds_hold_and_thin(rng):
    x = np.floor(256 * np.array([v for _, v, _ in vectors(600, 64, 3)])).astype(np.int32)
    p = hn.Packed(np.arange(600), np.arange(600), np.zeros(600, np.int64), x)
    p.summaries()
    exact = x.astype(np.int64) @ x.T.astype(np.int64)
    width = []
    for m, s in zip(p.mean, p.deviation, strict=True):
        middle, reach = m @ m.T, s @ s.T
        assert (np.abs(exact - middle) <= reach + 1e-4 * p.norm[:, None] * p.norm + 1).all()
        width.append(reach.mean())
    assert width[1] < width[0]
    tile = hn.Positives(p, 3)
    for at in range(0, 600, 100):
        tile.see(p.picked(np.arange(at, at + 100)))
    assert tile.counts[0] == 360_000 and tile.counts[0] > tile.counts[1] > tile.counts[2] > tile.counts[3]
    for i in range(600):
        order = sorted((-exact[i, j], j) for j in range(600) if j != i)[:3]
        assert [(-s, j) for s, j in order] == list(zip(tile.scores[i].tolist(), tile.ids[i].tolist(), strict=True))


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20) * 3e4], int(i % 2)) for i in range(60)]
    assert found(spark.createDataFrame(rows, VECTORS)) == sorted(plain(rows), key=repr)
