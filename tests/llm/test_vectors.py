import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipspark.llm import cross_polytope, hard_negatives

NAN, INF = float("nan"), float("inf")
#: vec_id, embedding, label: nulls, zeros, odd components, other lengths, repeated rows and ids, ties.
ODD = [
    (0, [1.0, 0.0, 0.0], 1),
    (100, [0.5, 0.5, 0.0], 1),
    (100, [0.5, 0.4, 0.0], 1),
    (1, [1.0, 0.0, 0.0], 2),
    (2, [1.0, 0.0, 0.0], 1),
    (3, [0.9, 0.1, 0.0], 2),
    (3, [0.9, 0.1, 0.0], 2),
    (4, [0.0, 0.0, 0.0], 2),
    (5, None, 2),
    (6, [None, 1.0, 1.0], 1),
    (8, [NAN, 1.0, 1.0], 1),
    (9, [INF, 1.0, 1.0], 1),
    (10, [-INF, 1.0, 1.0], 1),
    (None, [1.0, 0.0, 0.0], 1),
    (11, [-1.0, 0.0, 0.0], 2),
    (12, [1.0, 0.0], 1),
    (200, [0.0, 1.0], 1),
    (300, [], 1),
    (13, [], 2),
    (15, [1.0, 0.1, 0.0], None),
    (16, [100.0, 3.0, 7.0], 1),
    (17, [0.99, 0.02, 0.01], 2),
    (18, [0.98, 0.02, 0.01], 1),
    (400, None, 1),
    (500, [0.0, 0.0, 0.0], 1),
    (19, [1e-30, 2e-30, 0.0], 2),
]


def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return made.withColumns({"rank": F.lit(1), "key": F.lit("k"), "score": F.lit(0), "length": F.lit(2), "n": F.lit(1), "vector": F.lit("v"), "floor": F.lit(3)})


def many(n, size, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, size))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    v[:copies] = v[0] + rng.normal(size=(copies, size)) * 1e-3
    return [(i, [float(x) for x in v[i].astype(np.float32)], int(rng.integers(4))) for i in range(n)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_nearest(rows, k):
    rows = [(i, v) for i, v, _ in rows if i is not None and fine(v) and any(v)]
    out = []
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        a = min(v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if i != q and len(v) == len(a):
                d = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, v)))
                best[i] = min(d, best.get(i, INF))
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1)]
    return out


def found(frame, k=10, **how):
    got = cross_polytope.nearest(frame, frame.where(F.col("vec_id") % 100 == 0), k, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("blocks", [2000, 20])
def test_all_buckets_give_the_exact_answer(spark, monkeypatch, blocks):
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(cross_polytope, "HELD_PAIRS", 500)
    rows = many(700, 12, 1, copies=200)
    for (a, b, c, d), (e, f, g, h) in zip(found(frame(spark, rows), share=9.0), brute_nearest(rows, 10), strict=True):
        assert (a, b, c) == (e, f, g) and abs(d - h) < 1e-12


def test_recall(spark):
    rows = many(1500, 32, 2, copies=300)
    got = {(a, c) for a, _, c, _ in found(frame(spark, rows))}
    want = {(a, c) for a, _, c, _ in brute_nearest(rows, 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_odd_vectors(spark):
    got, want = found(frame(spark, ODD), share=9.0), brute_nearest(ODD, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 1e-12 for x, y in zip(got, want))
    assert found(frame(spark, ODD).limit(0)) == []
    assert found(frame(spark, ODD), k=1, share=9.0) == [x for x in got if x[1] == 1]


def test_hashes_are_rotations_and_probes_cheapest_first():
    rng = np.random.default_rng(3)
    unit = cross_polytope.directions(rng.normal(size=(50, 20)), 32)
    y = cross_polytope.rotated(unit, 1, 0, 32)
    assert np.allclose(y @ y.T, unit @ unit.T)
    how = cross_polytope.Shape(32, (32, 4), 30)
    keys, who = cross_polytope.probed(unit, how, 3)
    assert len(keys) == 50 * 30 and len(set(zip(keys, who))) == len(keys)
    for i in range(50):
        own = {cross_polytope.buckets(unit[[i]], how, t)[0] + t * how.buckets for t in range(3)}
        assert own == set(keys[who == i][:3])


def brute_negatives(rows, k=5, percent=80):
    taken = {}
    for i, v, label in rows:
        if i is not None and label is not None and fine(v):
            row = (str((label + 1) % 10 if i % 7 == 0 else label), [math.floor(256 * x) for x in v])
            taken[i] = min(row, taken.get(i, row))
    out = []
    for a in sorted(i for i in taken if i % 100 == 0):
        label, v = taken[a]
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in taken.items() if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in others if x[2] == label][:k]:
            hard = [x for x in others if x[2] != label and percent * -ps <= 100 * -x[0] <= 100 * -ps][:k]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(frame):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(hard_negatives.prepared(frame, label, F.col("vec_id") % 100 == 0))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("slice_rows, chunk, step", [(8192, 1024, 512), (100, 3, 16)])
def test_negatives_against_brute_force(spark, monkeypatch, slice_rows, chunk, step):
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(hard_negatives, "CHUNK_MEMBERS", chunk)
    monkeypatch.setattr(hard_negatives, "STEP_ROWS", step)
    rows = many(1500, 8, 4, copies=400)
    assert mined(frame(spark, rows)) == brute_negatives(rows)


def test_negatives_of_odd_vectors(spark):
    assert mined(frame(spark, ODD)) == brute_negatives(ODD)
    assert mined(frame(spark, ODD).limit(0)) == []


def test_walk_ends_early_and_large_scores_are_exact():
    rng = np.random.default_rng(5)
    big = rng.integers(-(2**29), 2**29, size=(60, 4))
    want = {"anchor": np.array([0]), "label": np.array(["a"], object), "vector": big[:1], "ceiling": np.array([2**63 - 1]), "floor": np.array([-(2**63)])}
    unit, norms = hard_negatives._directions(big)
    _, ids, scores = hard_negatives._walk(np.array(["a"] * 60, object), np.arange(60), big, norms * 1.1, want, True, 5)
    exact = sorted(((-sum(int(x) * int(y) for x, y in zip(big[0], w)), i) for i, w in enumerate(big) if i))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == exact
    # rows under a bound that certifies them away are never looked at, here because their bound is a lie
    near = np.tile([[1, 0]], (5000, 1))
    near[:20] = [1000, 0]
    bounds = near[:, 0].astype(float)
    near[4000:] = [100_000, 0]
    want |= {"anchor": np.array([-1]), "vector": np.array([[10, 0]])}
    _, ids, _ = hard_negatives._walk(np.array(["a"] * 5000, object), np.arange(5000), near, bounds, want, True, 5)
    assert list(ids) == [0, 1, 2, 3, 4]
