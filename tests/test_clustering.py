import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import clouds, cosines, frame

from codepairs.operators import blocks
from codepairs.operators.clustering import Forest, dense_rank_ids, density_cluster
from codepairs.operators.components import connected_components
from codepairs.session import settle


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(60)],
        [(99, i) for i in range(98)] + [(200, 201), (300, 300)],
        [(i, (i * 7) % 40) for i in range(40)],
        [(5, 5)],
        [],
    ],
)
def test_connected_components(spark, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)
    assert {r.node: r.root for r in connected_components(df).collect()} == brute_components(edges)


def test_long_paths_settle(spark):
    edges = [(i, i + 1) for i in range(400)]
    found = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(401)}


def test_dense_rank_ids(spark):
    df = spark.createDataFrame([(i * 10 % 970,) for i in range(400)], "r bigint").repartition(6)
    got = {r.r: r.cluster for r in dense_rank_ids(df, "r").collect()}
    assert got == {v: i for i, v in enumerate(sorted({i * 10 % 970 for i in range(400)}))}


def brute_density(m, threshold, min_pts):
    real = np.linalg.norm(m, axis=1) > 0
    near = (cosines(m) >= threshold) & real[:, None] & real[None, :]
    near |= np.diag(real)
    core = near.sum(axis=1) >= min_pts
    linked = near & core[:, None] & core[None, :]
    roots = brute_components([(int(i), int(j)) for i, j in zip(*np.nonzero(linked), strict=True)])
    number = {r: i for i, r in enumerate(sorted(set(roots.values())))}
    out = {}
    for i in range(len(m)):
        if core[i]:
            cluster = number[roots[i]]
        else:
            cluster = min((number[roots[int(j)]] for j in np.flatnonzero(near[i] & core)), default=-1)
        out[i] = (bool(core[i]), cluster)
    return out


@pytest.mark.parametrize(
    ("block_rows", "min_rows", "seed", "threshold", "min_pts", "copies"),
    [(16, 1, 1, 0.97, 5, 0), (16, 1, 2, 0.995, 4, 40), (64, 1, 3, 0.999, 3, 2), (64, 1, 4, 0.9, 8, 0), (1024, 64, 2, 0.995, 4, 40), (16, 1, 5, 0.6, 30, 90)],
)
def test_density_cluster(spark, monkeypatch, block_rows, min_rows, seed, threshold, min_pts, copies):
    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", min_rows)
    m = clouds(seed, 260, spread=0.12, copies=copies)
    m[7] = 0
    got = {r.id: (r.is_core, r.cluster) for r in density_cluster(frame(spark, m), "id", "vec", threshold, min_pts, block_rows).collect()}
    assert got == brute_density(m, threshold, min_pts)


def test_near_copies_cost_no_pairs(spark, monkeypatch):
    """Most points crowd into a few small balls: they are never compared with one another."""
    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", 1)
    rng = np.random.default_rng(5)
    middles = np.array([[1, 0, 0], [0.995, 0.0998, 0], [0, 1, 0]])
    crowd = np.concatenate([middles[i % 3] + 1e-3 * rng.normal(size=3) for i in range(300)]).reshape(-1, 3)
    rest = rng.normal(size=(40, 3))
    m = np.concatenate([crowd, rest]).astype(np.float32)
    threshold, min_pts = 0.99, 5
    weighted = settle(frame(spark, m).withColumn("_weight", F.lit(1).cast("bigint")), "weighted")
    celled, cells = blocks.in_cells(weighted, "id", "vec", 340, threshold, 8, "_weight", min_pts)
    assert cells.dense.sum() >= 3
    groups: dict = {}
    for r in blocks.block_pairs(celled, "id", 340, 8).collect():
        groups.setdefault((r._cell, r._a, r._b), []).append(r._k)
    work = sum(g.count(a) * g.count(b) for (_, a, b), g in groups.items())
    assert work < 340 * 340 / 4
    got = {r.id: (r.is_core, r.cluster) for r in density_cluster(frame(spark, m), "id", "vec", threshold, min_pts, 8).collect()}
    assert got == brute_density(m, threshold, min_pts)


def test_density_cluster_under_other_partitionings(spark, partitions):
    m = clouds(9, 200, copies=70)
    run = lambda: sorted(tuple(r) for r in density_cluster(frame(spark, m), "id", "vec", 0.98, 4).collect())
    first, second = partitions(run)
    assert first == second
    with pytest.raises(ValueError):
        density_cluster(frame(spark, m), "id", "vec", 0.0, 4)


def test_forest_joins_what_links_join_with_the_fewest():
    rng = np.random.default_rng(4)
    forest, links = Forest(80), []
    for _ in range(6):
        u, v = rng.integers(0, 80, 15), rng.integers(0, 80, 15)
        links += list(zip(u.tolist(), v.tolist(), strict=True))
        forest.add(u, v)

    def trees(pairs):
        root = list(range(80))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    kept = list(zip(*(x.tolist() for x in forest.links()), strict=True))
    assert trees(kept) == trees(links) and set(kept) <= set(links)
    assert len(kept) == 80 - len(set(trees(links)))
