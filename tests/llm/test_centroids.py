"""op11 against a plain version with Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tracewell.llm import centroids


def plain(rows, dims=64, scale=64, k=16, rounds=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in hashed[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min((far(v, w), i) for i, w in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    last = [near(v) for _, v in kept]
    each = [sum(d for d, a in last if a == j) for j in range(len(c))]
    return sorted(((i, a, d, each[a], sum(each), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(kept, last)), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def made(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string").repartition(4)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.integers(-40, 40, 64) / 64.0] for _ in range(150)]
    rows = [*enumerate(vectors), (7, vectors[7]), (8, vectors[9]), (None, vectors[3]), (None, vectors[4])]
    rows += [(900, None), (901, []), (902, vectors[0][:63]), (903, [*vectors[0], 0.0]), (904, [None, *vectors[0][1:]]), (905, [float("nan"), *vectors[0][1:]]), (906, [float("inf"), *vectors[0][1:]]), (907, [-0.0, *vectors[0][1:]]), (908, [1e-30, *vectors[0][1:]]), (909, [-1e-30, *vectors[0][1:]])]
    assert found(centroids.clusters(made(spark, rows, kind))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 15, 40])
def test_few_vectors_and_ties(spark, n):
    rows = [(i, [float(i % 3)] * 64) for i in range(n)]
    assert found(centroids.clusters(made(spark, rows))) == plain(rows)


def test_third_of_all_rows_equal(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.normal(0, 0.1, 64).astype(np.float32) if i % 3 else np.full(64, 0.125))]) for i in range(600)]
    assert found(centroids.clusters(made(spark, rows))) == plain(rows)


def test_nearest_abandons_and_keeps_ties():
    rng = np.random.default_rng(5)
    c = rng.integers(-9, 9, (16, 64))
    c[5] = c[3]
    v = np.concatenate([rng.integers(-9, 9, (500, 64)), c, c + 1])
    cluster, distance, finished = centroids.nearest(v, c, rng.permutation(64))
    whole = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert cluster.tolist() == whole.argmin(axis=1).tolist() and distance.tolist() == whole.min(axis=1).tolist()
    assert len(v) <= finished < len(v) * 16 * 0.7


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond a long"):
        centroids.clusters(made(spark, [(1, [3e6] * 64)], "double")).collect()
