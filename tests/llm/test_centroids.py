"""Centroid clustering against Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallygraph.llm import centroids, common


def brute(rows, k=8, rounds=10, width=64, scale=1024, salt=3):
    kept = [(i, [math.floor(float(x) * scale) if math.isfinite(float(x) * scale) else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    c = [v for _, v in start]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x)) for x in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [nearest(v)[0] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    done = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, _, d in done)
    of = [sum(d for _, a, d in done if a == j) for j in range(len(c))]
    small = lambda x: x if x < 1 << 63 else None
    return sorted(((i, a, small(d), small(of[a]), small(total), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, d in done), key=str)


def run(df, **options):
    return sorted((tuple(r) for r in centroids.clusters(df, **options).collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf, "embeddings").collect()]
    got = sorted((tuple(r) for r in centroids.op11_centroids(spark, sf).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("size", [1, 3, 2.0**16, 2.0**17, 2.0**40, 1e300, 1.7e308])
def test_ties_and_large_numbers(spark, size):
    """Few different values, so that ties abound; components beyond what a long
    or a double product holds."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) * size for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df, width=4, k=5, rounds=4) == brute(rows, width=4, k=5, rounds=4)


def test_intervals_hold_the_distance():
    """Screening never rules the nearest out, and does rule most others out;
    large components beside one another's multiples make it hard."""
    rng = np.random.default_rng(2)
    ruled = 0
    for scale in (10, 1 << 12, 1 << 20, 1 << 26):
        c = rng.integers(-scale, scale, (16, 64))
        c[8:] = c[:8] + rng.integers(-1, 2, (8, 64))
        v = np.concatenate((rng.integers(-scale, scale, (200, 64)), c + rng.integers(-1, 2, (16, 64))))
        screen = centroids.Screen(c.tolist(), 1)
        may = screen.candidates(v)
        d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert may[np.arange(len(v)), d.argmin(axis=1)].all()
        assert (may >= (d == d.min(axis=1)[:, None])).all()
        ruled += (~may).mean()
        label, far = screen.small(v)
        assert (label == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert ruled > 2


def test_odd_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, good), (1, good), (None, good), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, math.nan]), (6, [math.inf, 0.0]), (7, [0.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "'x' AS vec", "2 AS id", "3 AS distance", "4 AS x", "'h' AS h")
    assert run(df, width=2, k=2) == brute(rows, width=2, k=2)
    assert run(df, width=2, k=50) == brute(rows, width=2, k=50)
    assert run(df.limit(0)) == [] == run(df, width=9)
    assert centroids.clusters(df.limit(0)).schema.simpleString() == centroids.clusters(df, width=2).schema.simpleString()


def test_sums_travel_exactly():
    for x in (0, -1, 5, (1 << 40) - 1, 1 << 40, -(1 << 40), 3**90, -(3**200)):
        assert sum(v << (centroids.LIMB * i) for i, v in centroids.limbs(x)) == x
