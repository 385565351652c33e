"""Hard negatives against brute force in Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codepairs.llm.negatives import hard_negatives, op11_hard_negatives, spanning_tree, walk

SCHEMA = "vec_id long, embedding array<double>, label string, rank string, score string"


def floors(v):
    return [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v]


def brute(rows, every=100, positives=5, negatives=10):
    """Rows ``(id, label, vector)``; ties of equal ids are equal rows."""
    good = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None]
    good = [(i, lab, floors(v)) for i, lab, v in good if all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True))

    def fit(x):
        return x if -(2**63) <= x < 2**63 else None

    out = []
    for n, (a, lab, v) in enumerate(good):
        if a % every:
            continue
        scored = sorted((-score(v, w), i, other == lab) for m, (i, other, w) in enumerate(good) if m != n and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            inside = [(-s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, i, rank, j, fit(-p), fit(s)) for rank, (s, j) in enumerate(inside[:negatives], 1)]
    return sorted(out, key=repr)


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, lab, v in rows], SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, **kwargs)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_tree_has_parents_first_and_short_edges():
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.integers(-50, 50, size=(20, 5)), 10, axis=0) + rng.integers(-1, 2, size=(200, 5)).astype(float)
    order, up, edge = spanning_tree(rows)
    assert sorted(order) == list(range(200)) and up[0] == -1 and (up[1:] < np.arange(1, 200)).all() and (up[1:] >= 0).all()
    assert np.allclose(edge[1:], np.linalg.norm(rows[order[1:]] - rows[order[up[1:]]], axis=1))
    assert np.sort(edge)[-20] < 5 <= np.sort(edge)[-19]  # all but the 19 between the clumps are short
    assert [len(x) for x in spanning_tree(rows[:1])] == [1, 1, 1]


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16)) * 200
    anchors = np.floor(np.repeat(base, 20, axis=0) + rng.normal(size=(120, 16)) * 3)
    rows = np.floor(np.repeat(base, 100, axis=0) + rng.normal(size=(600, 16)) * 20)
    order, up, edge = spanning_tree(anchors)
    anchors = anchors[order]
    rescored = 0

    def wanted(i, low, high):
        exact = rows @ anchors[i]
        assert (low <= exact).all() and (exact <= high).all()
        return high >= np.sort(exact)[-20]

    for i, chosen, scores in walk(up, edge * (1 + 1e-9), anchors, rows, wanted):
        assert (scores == (rows @ anchors[i])[chosen]).all() and len(chosen) >= 20
        rescored += len(chosen)
    assert rescored < 120 * 600 / 3


@pytest.mark.parametrize("kind", ["random", "clumps", "ties"])
def test_tables(spark, kind):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 6))
    if kind == "random":
        vectors = rng.normal(size=(500, 6))
    elif kind == "clumps":
        vectors = base[rng.integers(12, size=500)] + rng.normal(size=(500, 6)) * 0.05
    else:
        vectors = rng.integers(0, 3, size=(500, 6)) / 2
    # One label holds a third of the rows.
    rows = [(i * 5, "hot" if i % 3 == 0 else f"l{rng.integers(4)}", v.tolist()) for i, v in enumerate(vectors)]
    want = brute(rows)
    assert len(want) > 200
    assert run(spark, rows) == want
    # Many tiles and trees.
    assert run(spark, rows, block_numbers=60, least_rows=50, tree_rows=4) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, "a", [1.0, 2.0]), (1, "a", [1.0, 2.5]), (2, "b", [0.5, 0.5]), (3, "b", [0.0, 0.0]), (4, "b", None), (5, None, [1.0, 1.0])]
    rows += [(6, "b", [nan, 1.0]), (7, "b", [1.0, inf]), (8, "b", [None, 1.0]), (None, "b", [1.0, 1.0]), (9, "b", []), (200, "a", [])]
    rows += [(10, "a", []), (11, "b", [1.0, 1.0, 1.0]), (300, "c", [0.0, 0.0]), (12, "c", [1.0, 1.0]), (2, "b", [0.5, 0.5]), (400, "a", [-1.0, -2.0])]
    rows += [(500, "d", [1e200, 1.7e308]), (13, "d", [1e200, 1e160]), (14, "b", [1e180, 8e159]), (600, "e", [1e9, 1e9]), (15, "e", [2e9, 0.0]), (16, "b", [1e9, 5e-324])]
    rows += [(700, "f", [1.0, 1.0]), (700, "f", [1.0, 1.0]), (17, "f", [5e8, 5e8])]
    want = brute(rows)
    assert {r[0] for r in want} >= {100, 200, 300, 500, 600, 700}
    assert run(spark, rows) == want
    assert run(spark, rows, block_numbers=4, least_rows=2, tree_rows=2) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, "a", [1.0]), (2, "b", [1.0])]) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, v if v is None else list(v)) for i, lab, v in rows]
    got = sorted((tuple(r) for r in op11_hard_negatives(spark, sf).collect()), key=repr)
    assert got == brute(rows) and len(got) > 20
