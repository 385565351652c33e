"""Centroid clustering against a full search in Python's whole numbers."""

import hashlib
import math

import numpy as np

from codepairs.llm.centroids import Search, centroid_digest, cluster_vectors, op13_centroids, with_inertia

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def brute(rows, clusters, rounds, components, scale=64):
    good = [(i, v) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v], v) for i, v in good]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, q) for i, q, v in kept if i is not None)
    centroids = [q for _, _, q in starts[:clusters]]
    if not centroids:
        return []

    def place(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        homes = [place(q)[1] for _, q, _ in kept]
        for c in range(len(centroids)):
            own = [q for (_, q, _), h in zip(kept, homes, strict=True) if h == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    told = [(i, *place(q)) for i, q, _ in kept]
    sums = {}
    for _, d, c in told:
        sums[c] = sums.get(c, 0) + d
    every = sum(sums.values())

    def fit(x):
        return x if x < 2**63 else None

    def added(ds, total):
        return None if any(d >= 2**63 for d in ds) else fit(total)

    by = {c: added([d for _, d, h in told if h == c], sums[c]) for c in sums}
    inertia = None if any(d >= 2**63 for _, d, _ in told) else fit(every)
    return [(i, c, fit(d), by[c], inertia, centroid_digest(centroids[c])) for i, d, c in told]


def run(spark, rows, clusters=5, rounds=3, components=4):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = with_inertia(*cluster_vectors(df, clusters, rounds, components))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_search_equals_full_search_and_computes_less():
    rng = np.random.default_rng(1)
    for centre, dim in ((0, 3), (50, 64), (0, 1)):
        base = rng.integers(-60, 60, size=(40, dim)) + centre
        centroids = base + rng.integers(-2, 3, size=base.shape)
        centroids[7] = centroids[3]  # a tie of whole centroids
        rows = base[rng.integers(40, size=3000)] + rng.integers(-3, 4, size=(3000, dim))
        found, best, computed = Search(centroids.tolist()).nearest(rows)
        full = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (best == full.min(axis=1)).all() and (found == full.argmin(axis=1)).all()
        assert computed < full.size / 2


def test_random_ties_and_copies(spark, partitions):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, size=4) / 64).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.25, -0.5, 0.0]) for i in range(150)] + [(7, [0.5, 0.25, -0.5, 0.0])]
    want = sorted(brute(rows, 5, 3, 4), key=repr)
    assert all(got == want for got in partitions(lambda: run(spark, rows)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [nan, 1.0, 1.0, 1.0]), (5, [1.0, inf, 1.0, 1.0]), (6, [None, 1.0, 1.0, 1.0])]
    rows += [(7, [1.0, 2.0, 3.0]), (8, [-0.0, 3.0, 1e-300, -1e-300]), (None, [1.0, 2.0, 3.0, 4.0]), (9, [1e300, 1.7e308, -1e160, 5e-324])]
    rows += [(10, [1e9, -1e9, 3.0, 1.0]), (10, [1e9, -1e9, 3.0, 1.0]), (11, [2.0, 2.0, 2.0, 2.0])]
    for clusters in (2, 5, 50):
        assert run(spark, rows, clusters) == sorted(brute(rows, clusters, 3, 4), key=repr)


def test_wide_sums_do_not_overflow(spark):
    rows = [(i, [2.0**56, -(2.0**56), 1.0, float(i)]) for i in range(40)] + [(100 + i, [0.0, 1.0, 2.0, float(i)]) for i in range(40)]
    got = run(spark, rows, 2)
    assert got == sorted(brute(rows, 2, 3, 4), key=repr) and len({r[1] for r in got}) == 2


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in op13_centroids(spark, sf).collect()), key=repr)
    assert got == sorted(brute(rows, 16, 3, 64), key=repr)
