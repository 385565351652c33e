from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codepairs.operators.blocks import block_pairs, in_cells, rows_per_block
from codepairs.operators.similarity import Best, cosine_all_pairs
from codepairs.session import settle


def clouds(seed, n, dim=4, centres=6, spread=0.15, copies=0):
    """Points around a few directions, most of them around the first, and some exact copies."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    which = np.where(rng.random(n) < 0.4, 0, rng.integers(0, centres, n))
    m = (middle[which] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    if copies:
        m[-copies:] = m[0]
    return m


def frame(spark, m):
    rows = [(i, f"l{i % 7}", v.tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id int, label string, vec array<float>")


def cosines(m):
    wide = m.astype(np.float64)
    norms = np.linalg.norm(wide, axis=1, keepdims=True)
    unit = np.divide(wide, norms, out=np.zeros_like(wide), where=norms > 0)
    return unit @ unit.T


@pytest.mark.parametrize("block_rows", [64, 1024])
def test_all_pairs(spark, block_rows):
    m = clouds(1, 150)
    m[3] = 0
    got = cosine_all_pairs(frame(spark, m), "id", "label", "vec", block_rows=block_rows).collect()
    want = cosines(m)
    assert len(got) == 150 * 150 == len({(r.source_id, r.target_id) for r in got})
    for r in got:
        assert abs(r.cosSim - want[r.source_id, r.target_id]) <= 1e-6
        assert (r.source, r.target, r["index"]) == (f"l{r.source_id % 7}", f"l{r.target_id % 7}", f"l{r.source_id % 7}_l{r.target_id % 7}")
    scores = {(r.source_id, r.target_id): r.cosSim for r in got}
    assert all(scores[j, i] == s for (i, j), s in scores.items())
    assert all(scores[i, i] == (0.0 if i == 3 else 1.0) for i in range(150))


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
@pytest.mark.parametrize("block_rows", [20, 1024])
def test_threshold_loses_no_pair(spark, monkeypatch, threshold, block_rows):
    from codepairs.operators import blocks

    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", 1)
    m = clouds(2, 300, copies=20)
    m[5] = 0
    want = cosines(m)
    pairs = {(i, j) for i, j in zip(*np.nonzero(want >= threshold), strict=True)}
    near_edge = {(i, j) for i, j in zip(*np.nonzero(np.abs(want - threshold) < 1e-9), strict=True)}
    got = cosine_all_pairs(frame(spark, m), "id", "label", "vec", threshold=threshold, block_rows=block_rows).collect()
    found = {(r.source_id, r.target_id) for r in got}
    assert len(got) == len(found)
    assert found - near_edge == pairs - near_edge


def test_pairs_meet_once_and_pruning_prunes(spark, monkeypatch):
    from codepairs.operators import blocks

    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", 1)
    m = clouds(3, 400, dim=3, centres=12, spread=0.02)
    stored = settle(frame(spark, m), "test-vectors")
    for threshold in (None, 0.99):
        rows = block_pairs(in_cells(stored, "id", "vec", 400, threshold, 16)[0], "id", 400, 16).collect()
        seen, total = set(), 0
        groups: dict = {}
        for r in rows:
            groups.setdefault((r._cell, r._a, r._b), []).append((r.id, r._k))
        for (_, a, b), members in groups.items():
            left, right = [i for i, k in members if k == a], [i for i, k in members if k == b]
            pairs = {(min(i, j), max(i, j)) for i in left for j in right if i != j}
            total += len(left) * (len(left) - 1) // 2 if a == b else len(left) * len(right)
            assert not pairs & seen
            seen |= pairs
        everything = 400 * 399 // 2
        if threshold is None:
            assert total == everything
        else:
            assert total < everything / 2
            want = cosines(m)
            assert all((i, j) in seen for i in range(400) for j in range(i + 1, 400) if want[i, j] >= threshold + 1e-9)


@pytest.mark.parametrize("block_rows", [64, 1024])
def test_top_k(spark, block_rows):
    m = clouds(4, 200, copies=15)
    want = np.round(cosines(m), 12)
    got = cosine_all_pairs(frame(spark, m), "id", "label", "vec", top_k=4, block_rows=block_rows).collect()
    best: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        best.setdefault(r.source_id, []).append(r.target_id)
    for i in range(200):
        order = sorted((j for j in range(200) if j != i), key=lambda j: (-want[i, j], j))[:4]
        assert best[i] == order


def test_top_k_within_a_threshold(spark):
    m = clouds(6, 150, copies=5)
    want = cosines(m)
    got = cosine_all_pairs(frame(spark, m), "id", "label", "vec", threshold=0.97, top_k=3, block_rows=64).collect()
    best: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        best.setdefault(r.source_id, []).append(r.target_id)
    for i in range(150):
        order = sorted((j for j in range(150) if j != i and want[i, j] >= 0.97), key=lambda j: (-round(want[i, j], 12), j))[:3]
        assert best.get(i, []) == order


def test_the_exact_cosine_decides(spark):
    """Shown with six digits, all of these are alike."""
    angles = [0.0, 3e-4, 2e-4, 1e-4]
    df = spark.createDataFrame([(i, "l", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "id int, label string, vec array<double>")
    got = {(r.source_id, r["rank"]): r.target_id for r in cosine_all_pairs(df, "id", "label", "vec", top_k=3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [3, 2, 1]
    half = spark.createDataFrame([(0, "l", [1.0, 0.0]), (1, "l", [0.4999996, float(np.sqrt(1 - 0.4999996**2))])], df.schema)
    assert cosine_all_pairs(half, "id", "label", "vec", threshold=0.5, top_k=1).collect() == []


def test_rows_are_shuffled_a_bounded_number_of_times(spark):
    """A larger table has larger blocks, not more copies of each row."""
    for n in (3_000, 60_000):
        rows = spark.range(n).selectExpr("id", "array(1.0D, id * 1.0D) as vec")
        assert block_pairs(in_cells(rows, "id", "vec", n, None, rows_per_block(n, 2))[0], "id", n, rows_per_block(n, 2)).count() <= 33 * n
    assert rows_per_block(10**9, 64) * 64 <= 1 << 21


def test_cells_that_spare_nothing_are_left_out(spark):
    stored = settle(frame(spark, np.random.default_rng(8).normal(size=(3000, 16)).astype(np.float32)), "test-vectors")
    assert in_cells(stored, "id", "vec", 3000, 0.2, 64)[1] is None
    near = settle(frame(spark, clouds(3, 3000, dim=3, centres=12, spread=0.02)), "test-vectors")
    assert in_cells(near, "id", "vec", 3000, 0.999, 64)[1] is not None


@pytest.mark.parametrize("threshold", [-np.inf, 0.3])
def test_best_partners_over_tiles(threshold):
    s = np.random.default_rng(1).integers(-10, 11, size=(23, 50)) / 10 + 1e-14 * np.random.default_rng(2).normal(size=(23, 50))
    ids = np.random.default_rng(3).permutation(50)
    for axis in (0, 1):
        best = Best(23, 4, threshold)
        for at in range(0, 23, 7):
            for col in range(0, 50, 9):
                tile = s[at : at + 7, col : col + 9]
                best.add(np.ascontiguousarray(tile if axis == 0 else tile.T), at, col, axis, ids)
        row, place, score = best.found()
        for i in range(23):
            want = sorted((j for j in range(50) if s[i, j] >= threshold), key=lambda j: (-round(s[i, j], 12), ids[j]))[:4]
            assert place[row == i].tolist() == want and np.array_equal(score[row == i], s[i, want])


def test_all_pairs_shuffles_each_row_once(spark):
    """Blocks are stored once and read by the tasks that pair them; no row is repeated on its way, also where ids repeat."""
    m = np.random.default_rng(5).normal(size=(90, 3))
    df = frame(spark, m).withColumn("id", F.col("id") % 80)
    pairs = cosine_all_pairs(df, "id", "label", "vec", block_rows=8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = Counter((r.source_id, r.target_id, r.cosSim) for r in pairs.collect())
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = Counter((i % 80, j % 80, float(np.round(unit[i] @ unit[j], 6) + 0.0)) for i in range(90) for j in range(90))
    assert sum(got.values()) == 90 * 90 and Counter(k[:2] for k in got.elements()) == Counter(k[:2] for k in want.elements())
    assert np.allclose(sorted(got.elements()), sorted(want.elements()), atol=2e-6)
    assert cosine_all_pairs(df.limit(0), "id", "label", "vec").collect() == []
