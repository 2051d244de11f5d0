"""Centroid clustering: equal to plain rounds, ties and odd vectors included."""

import hashlib
import math
import random

import numpy as np
import pytest

from inventra.llm.elkan import Round, begun, clustered, whole

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, distance string, upper int"


def plain(rows, k, rounds, salt="2:"):
    """(vec_id, cluster, distance, cluster's inertia, inertia, centroid), by the contract's words."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows if e is not None and len(e) == 3 and all(c is not None and math.isfinite(c) for c in e)]
    key = lambda i: (i is None, hashlib.sha256(f"{salt}{i}".encode()).hexdigest() if i is not None else "")
    centroids = [x for _, x in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (square(x, centroids[c]), c)) for _, x in kept]
        if step < rounds:
            for c in set(own):
                mine = [x for (_, x), o in zip(kept, own, strict=True) if o == c]
                centroids[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    far = [square(x, centroids[o]) for (_, x), o in zip(kept, own, strict=True)]
    return sorted(((i, o, d, sum(e for p, e in zip(own, far, strict=True) if p == o), sum(far), ",".join(map(str, centroids[o]))) for (i, _), o, d in zip(kept, own, far, strict=True)), key=repr)


def run(spark, rows, k, rounds):
    df = spark.createDataFrame([(*r, 1, "x", "c", "d", 2) for r in rows], SCHEMA).repartition(3)
    got = clustered(df, k=k, rounds=rounds, size=3)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got.collect()), key=repr)


def vectors(seed, n=150, grid=None):
    rng = random.Random(seed)
    make = (lambda: rng.randrange(-grid, grid + 1) / 64) if grid else (lambda: rng.gauss(rng.choice([-1, 0, 2]), 0.3))
    rows = [(i, [make() for _ in range(3)]) for i in range(n)]
    odd = [(1000, None), (1001, []), (1002, [1.0, 2.0]), (1003, [1.0, None, 2.0]), (1004, [math.nan] * 3), (1005, [math.inf, 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    return rows + rows[:4] + odd


@pytest.mark.parametrize(("seed", "grid", "k", "rounds"), [(1, None, 8, 5), (2, 1, 12, 5), (3, 3, 1, 2), (4, None, 400, 2), (5, 2, 5, 0)])
def test_equals_plain_rounds(spark, seed, grid, k, rounds):
    """With a coarse grid most distances tie and some centroids coincide."""
    rows = vectors(seed, 60 if k > 100 else 150, grid)
    assert run(spark, rows, k, rounds) == plain(rows, k, rounds)


def test_empty(spark):
    got = clustered(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and got.collect() == []
    assert run(spark, [(1, [math.nan] * 3)], 4, 2) == []


def test_bounds_hold_and_spare_distances():
    """Bounds enclose the true distances in every round, and most distances aren't computed."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-40, 40, (400, 8)) + 900 * i for i in range(6)]).astype(np.int64)
    centroids, before, done = x[rng.permutation(len(x))[:12]].copy(), None, 0
    own, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf, np.float32), np.zeros((len(x), 12), np.float32)
    for _ in range(6):
        own, upper, lower, n = Round(centroids, before).assign(x, own, upper, lower)
        done += n
        true = ((x[:, None, :] - centroids[None]) ** 2).sum(-1)
        assert (own == true.argmin(1)).all()
        assert (upper.astype(np.float64) ** 2 >= true[np.arange(len(x)), own] * (1 - 1e-12)).all() and (lower.astype(np.float64) ** 2 <= true * (1 + 1e-12)).all()
        before, centroids = centroids, np.array([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centroids[c] for c in range(12)])
    assert done < 0.4 * 6 * 12 * len(x)


def test_large_components(spark):
    """Components whose squares would pass a long are left out; below that distances are exact."""
    rows = [(1, [400_000.0, 0.0, 0.0]), (2, [-400_000.0, 0.0, 0.0]), (3, [1e30, 0.0, 0.0])]
    got = run(spark, rows, 1, 0)
    assert [r[:2] for r in got] == [(1, 0), (2, 0)] and sorted(r[2] for r in got) == [0, (2 * 256 * 400_000) ** 2]
    assert begun(whole(spark.createDataFrame([(5, [0.1])], "vec_id long, embedding array<float>"), 1), 3, "2:").tolist() == [[25]]
