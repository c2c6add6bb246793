"""Hard negatives: subset-sum scores and the mined rows against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelab.llm import hard_negatives as hn


@pytest.mark.parametrize(("d", "low", "high"), [(1, 0, 1), (8, -1, 1), (13, -300, 300), (64, 0, 5), (20, -(1 << 40), 1 << 20), (3, -1, 0)])
def test_scores(rng, d, low, high):
    a, b = rng.integers(low, high, (5, d)), rng.integers(low, high, (9, d))
    planes = 1 + max(max(int(-1 - min(-1, b.min())), int(max(0, b.max()))).bit_length(), 0)
    want = np.array([[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for x in a] for y in b], dtype=object)
    if max(abs(int(v)) for v in want.ravel()) < 1 << 62:
        assert (hn.scores(hn.bit_planes(b, planes), hn.subset_sums(a)) == want.astype(np.int64)).all()


def test_best_keeps_order(rng):
    best = hn.Best(3, 4)
    seen = [[], [], []]
    for _ in range(12):
        score, allowed, ids = rng.integers(-3, 3, (20, 3)), rng.random((20, 3)) < 0.8, rng.permutation(1000)[:20]
        best.add(0, score, allowed, ids)
        for c in range(3):
            seen[c] += [(-int(s), int(i)) for s, i, ok in zip(score[:, c], ids, allowed[:, c], strict=True) if ok]
    for c in range(3):
        assert [(-s, i) for s, i in zip(best.score[c].tolist(), best.id[c].tolist(), strict=True)] == sorted(seen[c])[:4]


def brute(rows, k=5, every=100):
    """rows: (vec_id, label, vector); distinct, valid ones only."""
    q = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows}
    out = set()
    for i, l, v in q:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in q if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == l)[:k]:
            fits = sorted(x for x in score if x[2] != l and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out |= {(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)}
    return out


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS q", "0.5 AS score")
    return {tuple(r) for r in hn.mine(docs, F.col("id") % 100 == 0, F.col("label"), **options).collect()}


def test_against_brute_force(spark, rng):
    rows = [(int(i) * 20, int(i % 3), [float(x) for x in rng.normal(0.4, 0.3, 11)]) for i in range(150)]
    rows += [(20_000 + i, i % 2, rows[0][2]) for i in range(30)]  # ties
    rows += [(40_000 + 50 * i, i % 2, [float(x) for x in rng.normal(1, 1, 3)]) for i in range(20)]  # another length
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, batch=3) == want


def test_hot_label_and_moved_labels(spark, rng):
    rows = [(i, 1 if i % 3 else i % 10, [float(x) for x in rng.normal(0.2, 0.2, 8)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    moved = [(i, (l + 1) % 10 if i % 7 == 0 else l, [float(np.float32(x)) for x in v]) for i, l, v in rows]
    assert {tuple(r) for r in hn.default_mine(docs).collect()} == brute(moved)


def test_odd_rows(spark, monkeypatch):
    good = [(i, i % 2, [0.5 + i / 100, 0.25]) for i in range(0, 400, 25)]
    odd = [(None, 1, [0.5, 0.5]), (500, None, [0.5, 0.5]), (600, 1, None), (700, 1, [None, 0.5]), (800, 1, [float("nan"), 0.5]), (900, 0, [float("inf"), 0.5]), (1000, 0, [1e300, 0.5]), (1100, 1, [])]
    want = brute(good)
    assert want and mined(spark, good + odd + good[:3]) == want  # repeated rows count once
    big = [(i, i % 2, [float((1 << 20) + i), -3.0]) for i in range(0, 400, 50)]
    assert mined(spark, big) == brute(big)
    shared = [*good, (100, 1, [0.7, 0.1]), (100, 0, [0.2, 0.9])]  # one id, several vectors and labels
    assert {x[:2] + x[3:] for x in mined(spark, shared)} <= {x[:2] + x[3:] for x in brute(shared, k=50)}
    assert all(x[0] != x[1] and x[0] != x[3] for x in mined(spark, shared))


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == set() and mined(spark, [(1, 1, [0.1]), (2, 2, [0.1])]) == set()
    assert mined(spark, [(100, 1, [0.1])]) == set() and mined(spark, [(100, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])]) == {(100, 1, 1, 2, 0, 0)}


def test_share_without_overflow():
    s = np.array([0, 1, 4, 5, 6, -10, (1 << 62) + 3], dtype=np.int64)
    assert hn.share_of(s, (4, 5)).tolist() == [-((-4 * int(x)) // 5) for x in s]
