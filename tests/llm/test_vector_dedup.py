"""Near-duplicate vectors and components against brute force."""

import math
import random

import numpy as np
import pytest

from codepairs.llm.components import components
from codepairs.llm.vector_dedup import near_vectors, op5_vector_dedup

SCHEMA = "vec_id long, embedding array<double>, cell string, p string"


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, cosine=0.95):
    unit = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[n] = np.array(v) / np.linalg.norm(v)
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    links = {n: 0 for n in range(len(rows))}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    group = union(range(len(rows)), pairs)
    least = {}
    for n, g in group.items():
        if rows[n][0] is not None:
            least[g] = min(least.get(g, rows[n][0]), rows[n][0])
    out = []
    for n, (i, _) in enumerate(rows):
        c = least.get(group[n]) if i is not None else None
        out.append((i, links[n], c, i is None or i == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def data(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_groups_copies_and_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 8))
    rows = [(i, (base[rng.integers(25)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.3])).tolist()) for i in range(300)]
    rows += [(400 + i, (base[0] * (1 + i % 2)).tolist()) for i in range(90)]
    assert got(near_vectors(data(spark, rows), deviations=math.inf, block_rows=block_rows)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0])]
    rows += [(7, [1.0, 2.1]), (7, [5.0, -1.0]), (None, [1.0, 2.0]), (8, [1.0, 2.0, 0.0]), (9, [-0.0, 1.0]), (10, [0.0, 2.0])]
    assert got(near_vectors(data(spark, rows))) == brute(rows)


def test_empty_and_all_invalid(spark):
    assert near_vectors(data(spark, [])).collect() == []
    assert got(near_vectors(data(spark, [(1, None)]))) == [(1, 0, 1, True)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op5_vector_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    pairs = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(200)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }[shape]
    df = spark.createDataFrame(pairs, "u long, v long")
    want = union({i for p in pairs for i in p}, pairs)
    want = {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert {r.node: r.component for r in components(df).collect()} == want


@pytest.mark.parametrize("rank, dim, noise", [(4, 64, 0.0), (6, 768, 0.001)])
def test_vectors_that_vary_in_few_directions(spark, rank, dim, noise):
    """The query's defaults on clustered vectors of low rank: no link is lost between cells."""
    rng = np.random.default_rng(3)
    few = rng.normal(size=(60, rank))[rng.integers(60, size=1500)] + 0.3 * rng.normal(size=(1500, rank))
    x = few @ rng.normal(size=(rank, dim)) + noise * rng.normal(size=(1500, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    group = union(range(len(x)), zip(*(p.tolist() for p in np.nonzero(np.triu(near, 1))), strict=True))
    rows = near_vectors(data(spark, [(i, v) for i, v in enumerate(x.tolist())]), block_rows=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == {i: (want[i], group[i]) for i in want}
