"""Hierarchical clusters against a plain top-down condensation of a full tree."""

import math

import numpy as np
import pyarrow as pa
import pytest

from codepairs.operators.hierarchy import LEAST_LEVEL, hierarchical_cluster, reachability_tree


def folded(rows):
    """Distinct usable vectors in units of a power of two: ids, scaled vectors, weights, members."""
    members = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            members.setdefault(tuple(float(x) + 0.0 for x in v), []).append(i)
    top = max((abs(x) for v in members for x in v), default=0.0)
    scale = 2.0 ** math.frexp(top)[1] if top else 1.0
    order = sorted(members, key=lambda v: min(members[v]))
    return [min(members[v]) for v in order], np.array(order) / scale, [len(members[v]) for v in order], [members[v] for v in order], scale


def brute_tree(ids, x, weights, min_samples):
    n = len(ids)
    apart = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    core = []
    for i in range(n):
        near = np.repeat(np.sort(apart[i]), np.array(weights)[np.argsort(apart[i], kind="stable")])
        core.append(near[min_samples - 1])
    pairs = sorted((max(apart[i, j], core[i], core[j]), ids[i], ids[j], i, j) for i in range(n) for j in range(i + 1, n))
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    edges = []
    for w, u, v, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            edges.append((w, u, v, i, j))
    return core, edges


def brute_labels(rows, size, min_samples, single=False):
    ids, x, weights, members, _ = folded(rows)
    n = len(ids)
    if sum(weights) < max(size, min_samples):
        return {}
    core, edges = brute_tree(ids, x, weights, min_samples)

    def dense(level):
        return 1 / max(level, LEAST_LEVEL)

    def inside(start, kept):
        todo, seen = [start], {start}
        while todo:
            at = todo.pop()
            for _, _, _, i, j in kept:
                for a, b in ((i, j), (j, i)):
                    if a == at and b not in seen:
                        seen.add(b)
                        todo.append(b)
        return seen

    clusters = []  # [birth density, sum of leaving densities, count, children, points]

    def weigh(points):
        return sum(weights[p] for p in points)

    def part(points, kept, birth, parent):
        """A cluster born at ``birth``: follow it down until it splits or dissolves."""
        me = len(clusters)
        clusters.append([birth, 0.0, weigh(points), [], dict.fromkeys(points)])
        mass = 0.0
        while True:
            if not kept:
                (only,) = points
                mass += weights[only] * dense(core[only])
                break
            w, _, _, i, j = kept[-1]
            kept = kept[:-1]
            a = inside(i, kept)
            b = points - a
            ka, kb = [e for e in kept if e[3] in a], [e for e in kept if e[3] in b]
            if weigh(a) >= size and weigh(b) >= size:
                mass += weigh(points) * dense(w)
                clusters[me][3] = [part(a, ka, dense(w), me), part(b, kb, dense(w), me)]
                break
            if weigh(a) < size and weigh(b) < size:
                mass += weigh(points) * dense(w)
                break
            small, points, kept = (a, b, kb) if weigh(a) < size else (b, a, ka)
            mass += weigh(small) * dense(w)
        clusters[me][1] = mass
        return me

    part(set(range(n)), edges, 0.0, None)
    chosen = set()

    def best(c, top):
        birth, mass, count, children, _ = clusters[c]
        below, picked = 0.0, set()
        for child in children:
            s, p = best(child, False)
            below += s
            picked |= p
        own = mass - count * birth
        if (not top or single) and own >= below * (1 - 1e-9):
            return own, {c}
        return max(own, below), picked

    chosen = best(0, True)[1]
    groups = sorted((min(ids[p] for p in clusters[c][4]), c) for c in chosen)
    return {i: k for k, (_, c) in enumerate(groups) for p in clusters[c][4] for i in members[p]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<double>, weight string, p string")


def blobs(seed, sizes, spreads, dim=2, noise=10):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=dim) * 10 + rng.normal(size=(n, dim)) * s for n, s in zip(sizes, spreads, strict=True)]
    x = np.concatenate([*parts, rng.uniform(-20, 20, size=(noise, dim))])
    return [(int(i) * 3, v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]


CASES = {
    "blobs of unlike density": (blobs(1, (60, 60, 40, 80), (0.2, 2.0, 0.6, 4.0)), 5, None),
    "lines of growing gaps": ([(2 * i + (s > 0), [s * 1.08**i + s * 100, 0.0]) for s in (1, -1) for i in range(60)], 4, 2),
    "many copies": (blobs(2, (30, 30), (0.3, 1.0)) + [(1000 + i, [1.0, 2.0]) for i in range(40)] + [(2000 + i, [1.0, 2.5]) for i in range(3)], 5, 3),
    "grid of ties": ([(i, [float(i % 10), float(i // 10)]) for i in range(100)] + [(500 + i, [50.0 + i % 4, float(i // 4)]) for i in range(16)], 6, 4),
    "wide vectors": (blobs(3, (50, 70, 30), (0.5, 0.8, 0.3), dim=16), 10, 5),
}


@pytest.mark.parametrize("case, cell_rows", zip(CASES, (11, 30, 512, 9, 25), strict=True))
def test_equals_plain_condensation(spark, case, cell_rows):
    rows, size, samples = CASES[case]
    want = brute_labels(rows, size, samples or size)
    got = {r.id: r.cluster for r in hierarchical_cluster(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", size, samples, cell_rows=cell_rows).collect()}
    assert got == {i: want.get(i, -1) for i, _ in rows}
    assert case.startswith("grid") or len(set(want.values())) >= 2


def test_tree_of_500_vectors(spark):
    rows = blobs(5, (150, 150, 100, 90), (0.3, 1.0, 2.0, 0.1), dim=4)
    ids, x, weights, _, scale = folded(rows)
    want = [(u, v, round(w * scale, 9)) for w, u, v, _, _ in brute_tree(ids, x, weights, 5)[1]]
    got = [(r.u, r.v, round(r.weight, 9)) for r in reachability_tree(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", 5, 25).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows) - 1


def test_near_cells_alone_meet(spark, monkeypatch):
    """Of 40 far clumps of a cell each, next to no two cells are compared."""
    from codepairs.operators import hierarchy

    rng = np.random.default_rng(8)
    rows = [(c * 20 + i, [c * 1000.0 + x, y]) for c in range(40) for i, (x, y) in enumerate(rng.normal(size=(20, 2)).tolist())]
    met = []
    plain = hierarchy._met

    def counted(points, pairs, fn, schema):
        met.append(pairs.filter("a <> b").count())
        return plain(points, pairs, fn, schema)

    monkeypatch.setattr(hierarchy, "_met", counted)
    got = hierarchical_cluster(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", 10, cell_rows=20)
    assert len({r.cluster for r in got.collect()} - {-1}) == 40
    assert max(met) < 40 * 39 / 2 / 4


def test_single_cluster(spark):
    rows = blobs(9, (80,), (1.0,), noise=0)
    df = frame(spark, [(i, v, "x", "y") for i, v in rows])
    want = brute_labels(rows, 30, 5, True)
    got = {r.id: r.cluster for r in hierarchical_cluster(df, "id", "vec", 30, 5, True).collect()}
    assert got == {i: want.get(i, -1) for i, _ in rows} and set(want.values()) == {0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1e300 + i * 1e297, 1e-300]) for i in range(6)] + [(10 + i, [-1e300 - i * 1e296, 0.0]) for i in range(6)]
    odd = [(100, None), (101, []), (102, [nan, 1.0]), (103, [None, 1.0]), (104, [inf, 1.0]), (None, [1.0, 1.0])]
    df = frame(spark, [(i, v, "x", "y") for i, v in good + odd])
    got = hierarchical_cluster(df, "id", "vec", 3).collect()
    want = brute_labels(good, 3, 3)
    assert sorted(((r.id, r.cluster) for r in got), key=str) == sorted([(i, want.get(i, -1)) for i, _ in good + odd], key=str)
    assert len(reachability_tree(df, "id", "vec", 3).collect()) == 11


def test_repeated_ids(spark):
    rows = [(i % 7, [float(i // 20) * 100 + i % 20, 0.5 * i]) for i in range(60)]
    renamed = sorted(rows, key=lambda r: r[0])
    got = hierarchical_cluster(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", 8)
    assert sorted(r.id for r in got.collect()) == sorted(i for i, _ in rows)
    assert len({r.cluster for r in got.collect()}) == 3
    assert len(reachability_tree(frame(spark, [(i, v, "x", "y") for i, v in renamed]), "id", "vec", 4).collect()) == 59


def test_too_few_and_none(spark):
    for rows in ([], [(1, [0.0, 0.0], "x", "y")], [(i, [float(i)], "x", "y") for i in range(4)]):
        got = hierarchical_cluster(frame(spark, rows), "id", "vec", 5).collect()
        assert sorted((r.id, r.cluster) for r in got) == [(r[0], -1) for r in rows]
        assert reachability_tree(frame(spark, rows), "id", "vec", 5).collect() == []
    same = frame(spark, [(i, [1.0, 2.0], "x", "y") for i in range(7)])
    assert {r.cluster for r in hierarchical_cluster(same, "id", "vec", 5).collect()} == {-1}
    assert {r.cluster for r in hierarchical_cluster(same, "id", "vec", 5, single=True).collect()} == {0}
    with pytest.raises(ValueError, match="length"):
        hierarchical_cluster(frame(spark, [(1, [1.0], "x", "y"), (2, [1.0, 2.0], "x", "y")]), "id", "vec")


def test_tree_where_no_box_parts(spark, monkeypatch):
    """In 24 dimensions all cells are near: a row is shuffled once per block, and the tree needs no condensed hierarchy."""
    from codepairs.operators import hierarchy

    rng = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(420, 24)).tolist())]
    ids, x, weights, _, scale = folded(rows)
    want = [(u, v, round(w * scale, 9)) for w, u, v, _, _ in brute_tree(ids, x, weights, 5)[1]]
    names, dealt = [], []
    settle, met = hierarchy.settle, hierarchy._met

    def named(df, name):
        names.append(name)
        return settle(df, name)

    def counted(points, pairs, fn, schema):
        def shuffled(key, left, right):
            return pa.table({"n": [len(left)]})

        dealt.append(met(points, pairs, shuffled, "n long").groupBy().sum("n").first()[0])
        return met(points, pairs, fn, schema)

    monkeypatch.setattr(hierarchy, "settle", named)
    monkeypatch.setattr(hierarchy, "_met", counted)
    monkeypatch.setattr(hierarchy, "BLOCKS", 3)
    got = [(r.u, r.v, round(r.weight, 9)) for r in reachability_tree(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", 5, 10).collect()]
    assert sorted(got) == sorted(want) and len(got) == 419
    assert "cluster-joins" not in names
    assert max(dealt) <= 420 * 4


def test_squares_are_within_their_bound():
    from codepairs.operators.hierarchy import _between_rows, _squares, distances

    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 0.0), (1e-9, 1.0), (1e-160, 0.0), (0.0, 1.0)):
        x, y = (rng.normal(size=(50, 17)) * scale + shift for _ in range(2))
        want = distances(x, y)
        square, off = _squares(x, y)
        assert (np.abs(square - want**2) <= off).all()
        i, j = np.nonzero(want >= 0)
        assert (_between_rows(x, y, i, j) == want[i, j]).all()


def test_listed_edges_spare_rounds(spark, monkeypatch):
    """Where lists of the nearest points hold the first edge of every component, no round compares all points once more."""
    from codepairs.operators import hierarchy

    rng = np.random.default_rng(13)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(400, 24)).tolist())]
    ids, x, weights, _, scale = folded(rows)
    want = [(u, v, round(w * scale, 9)) for w, u, v, _, _ in brute_tree(ids, x, weights, 5)[1]]
    met, plain = [], hierarchy._met

    def counted(points, pairs, fn, schema):
        met.append(points.count())
        return plain(points, pairs, fn, schema)

    monkeypatch.setattr(hierarchy, "_met", counted)
    got = [(r.u, r.v, round(r.weight, 9)) for r in reachability_tree(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", 5, 25).collect()]
    assert sorted(got) == sorted(want)
    assert met[0] == 400 and sum(met[1:]) < 400


@pytest.mark.parametrize("kind", ["clumps", "grid"])
def test_lists_that_hold_one_component_only(spark, kind):
    """Clumps of more points than are listed, and equal distances without end, against brute force."""
    rng = np.random.default_rng(14)
    if kind == "clumps":
        places = [c * 40.0 + 0.01 * v for c in rng.normal(size=(8, 3)) for v in rng.normal(size=(25, 3))]
        places += [*rng.normal(size=(40, 3)) * 40]
        places += places[:7]
    else:
        places = [np.array([i, j, (i * j) % 2], dtype=float) for i in range(13) for j in range(13)]
    rows = list(enumerate(np.array(places).tolist()))
    ids, x, weights, members, scale = folded(rows)
    want = [(u, v, round(w * scale, 9)) for w, u, v, _, _ in brute_tree(ids, x, weights, 4)[1]]
    got = [(r.u, r.v, round(r.weight, 9)) for r in reachability_tree(frame(spark, [(i, v, "x", "y") for i, v in rows]), "id", "vec", 4, 20).collect()]
    again = {i for m in members for i in m[1:]}
    assert len(got) == len(rows) - 1 and sorted(e for e in got if e[1] not in again) == sorted(want)


def test_near_pairs_are_dropped_on_the_way(monkeypatch):
    from codepairs.operators import hierarchy

    rng = np.random.default_rng(15)
    x = rng.normal(size=(90, 5))
    points = pa.table({"cell": np.repeat(np.arange(6), 15), "p": np.arange(90), "vec": pa.array(x.tolist()), "weight": np.ones(90, np.int64), "reach": np.full(90, np.inf)})
    pairs = pa.table({"a": [a for a in range(6) for b in range(a, 6)], "b": [b for a in range(6) for b in range(a, 6)]})
    apart = hierarchy.distances(x, x)
    for held in (1, 1 << 20):
        monkeypatch.setattr(hierarchy, "NEAR_PAIRS", held)
        got = hierarchy._nearest(4)(None, points, pairs).to_pydict()
        assert got["p"] == np.repeat(np.arange(90), 4).tolist()
        assert got["d"] == np.sort(apart, axis=1)[:, :4].ravel().tolist() and (apart[got["p"], got["q"]] == got["d"]).all()
