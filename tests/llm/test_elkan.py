"""Bounded assignment against all distances."""

import hashlib
import random

import numpy as np

from quillspark.llm import elkan

R = random.Random(11)


def brute(vectors, k, rounds, dims, scale=256, seed=2):
    """vectors: (id, components). Lists of (id, cluster, distance) and the digests."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    h = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i is None, i or 0, *near(v)[::-1]) for i, v in kept)), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]


def run(spark, vectors, k, rounds, dims):
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in vectors], "vec_id long, embedding array<float>, cluster int, v string").repartition(5)
    return elkan.cluster(df, k=k, rounds=rounds, dims=dims).collect()


def check(rows, vectors, k, rounds, dims):
    want, digests = brute(vectors, k, rounds, dims)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in rows) == want
    inertia = sum(w[3] for w in want)
    for r in rows:
        assert r.centroid_sha256 == digests[r.cluster] and r.inertia == inertia
        assert r.cluster_inertia == sum(w[3] for w in want if w[2] == r.cluster)


def f32(x):
    return float(np.float32(x))


def test_blobs_and_odd_rows(spark):
    mids = [[R.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    vectors = [(i, [f32(m + R.gauss(0, 0.2)) for m in R.choice(mids)]) for i in range(300)]
    vectors += [(500, None), (501, [1.0] * 7), (502, [1.0] * 7 + [None]), (503, [float("nan")] + [0.0] * 7), (504, [float("inf")] + [0.0] * 7), (505, [0.0] * 8), (None, [0.5] * 8), (7, vectors[7][1]), (7, vectors[7][1]), (8, [0.25] * 8)]
    check(run(spark, vectors, 9, 4, 8), vectors, 9, 4, 8)


def test_ties_go_to_the_smaller_number(spark):
    grid = [(i, [float(R.randrange(3)) / 64 for _ in range(4)]) for i in range(400)]  # few distinct places: many equal distances
    check(run(spark, grid, 20, 5, 4), grid, 20, 5, 4)
    line = [(i, [i % 5 - 2.0]) for i in range(50)]
    check(run(spark, line, 7, 3, 1), line, 7, 3, 1)


def test_few_or_no_vectors(spark):
    few = [(i, [float(i), 1.0]) for i in range(3)]
    check(run(spark, few, 40, 2, 2), few, 40, 2, 2)
    assert run(spark, [(1, [0.0])], 40, 2, 2) == []
    assert elkan.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_skip_distances_and_hold():
    rng = np.random.default_rng(3)
    mids = rng.integers(-400, 400, (8, 16))
    v = (mids[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int32)
    c, before = mids.astype(np.int64) + 3, None
    a, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), 8))
    for r in range(4):
        step = elkan.Step(c, before)
        a, upper, lower = step(v, a, elkan._single(upper, np.inf), elkan._single(lower, -np.inf))
        full = np.stack([elkan._distances(v, np.broadcast_to(x, v.shape)) for x in c], 1)
        assert np.array_equal(a, full.argmin(1))
        assert (upper >= np.sqrt(full[np.arange(len(v)), a])).all() and (lower <= np.sqrt(full)).all()
        if r:
            assert step.computed < 0.5 * full.size
        before, c = c, np.array([v[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(8)])


def test_far_components_count_as_the_bound(spark):
    vectors = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])]
    rows = {r.vec_id: r for r in run(spark, vectors, 2, 1, 2)}
    assert len(rows) == 3 and all(r.distance >= 0 and r.inertia >= r.distance for r in rows.values())
