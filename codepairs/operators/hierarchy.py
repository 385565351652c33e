"""Hierarchical density clustering: clusters of varying density, without a radius.

The method is that of Campello, Moulavi and Sander, "Density-Based Clustering
Based on Hierarchical Density Estimates" (PAKDD 2013). The core distance of a
point is that to its ``min_samples``-th nearest point, itself included; two points
are as far apart as the greatest of their distance and their core distances. The minimum
spanning tree of these distances is grown in Borůvka's rounds: every component
takes its shortest edge outward, and components so linked become one.

Points are sorted along a space-filling curve and cut into cells of bounded
size, each with its box. Two cells meet only if their boxes are near enough to
matter: for core distances, within what a cell needs by itself; in a round,
within the shortest outward edge that its components are known to have, and not if both
lie wholly in one component. The cells' pairs are found by products of blocks
of cells. So work follows the pairs of near cells, not those of points. Points are
shuffled by blocks of neighbouring cells, once per block with a near cell: in many
dimensions, where all cells are near, the shuffle so grows with the blocks. Pairs of points are told apart by a
matrix product and its error bound; the few that this leaves open are computed by coordinate.

Where the tree alone is wanted, every point keeps the edges to its nearest points, and no edge that is kept at neither end is
shorter than the last that is kept at either. Rounds are settled by these lists; only points that may have a shorter edge than
the shortest listed one of their component meet in cells. Of components that lie in their own lists, these are all points.

The hierarchy is condensed in the same rounds. Inside a new component the old
ones join a growing one in the order of their edges, the shortest first; a join that is
longer than the component's own edge outward waits for the round in which it
is not. So a running sum of sizes tells which joins are splits of two clusters,
which let points fall out of one, and where a cluster begins. Stabilities and
the choice between a cluster and its descendants are running sums and maxima
along that order. The joins are range-partitioned by component and edge, so one
that takes in most of the points is no task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.operators.blocks import matrix
from codepairs.operators.clustering import dense_rank_ids
from codepairs.session import bounded_broadcast, settle

CELL_ROWS = 512
CELL_BLOCK = 2048
# Blocks of cells that a table is cut into, unless these would be smaller than two cells or larger than so many.
BLOCKS, BLOCK_CELLS = 16, 32
BLOCK_BITS = 32  # of a cell's number, below that of its block
# Pairs whose distances are computed by coordinate at once.
OPEN_PAIRS = 1 << 15
# Nearest points whose edges are kept with a point.
LISTED = 8
# Near pairs of points that are held before all but the nearest of each are dropped.
NEAR_PAIRS = 1 << 20
# Coordinates that order the cells, and bits of each.
CURVE_DIMS, CURVE_BITS = 3, 20
# Boxes are widened by this share, far above rounding.
SLACK = 1e-9
# Levels below this share of the largest extent count as that: copies have no density of their own.
LEAST_LEVEL = 1e-9
# Scores closer than this count as equal.
SAME_SCORE = 1e-9

POINT = "cell long, p long, vec array<double>, weight long, reach double, lo array<double>, hi array<double>"
EDGE = "comp long, other long, w double, u long, v long"


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by coordinate, so that a pair has the same one in any block and either order."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        step = x[:, j, None] - y[None, :, j]
        out += step * step
    return np.sqrt(out)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squares of the distances by a product, and how far they may be from those of ``distances``."""
    centre = x.mean(axis=0)
    x, y = x - centre, y - centre
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    found = x @ y.T
    found *= -2.0
    found += a[:, None]
    found += b[None, :]
    return np.maximum(found, 0.0, out=found), (x.shape[1] + 16) * 2.0**-50 * float(a.max() + b.max()) + 1e-300


def _between_rows(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances(x, y)[i, j]``, to the bit: squares are added up in the same order."""
    out = np.empty(len(i))
    for at in range(0, len(i), OPEN_PAIRS):
        step = x[i[at : at + OPEN_PAIRS]] - y[j[at : at + OPEN_PAIRS]]
        out[at : at + OPEN_PAIRS] = np.cumsum(step * step, axis=1)[:, -1]
    return np.sqrt(out)


# -- cells ----------------------------------------------------------------------


def _curve(dims: list[int], low: np.ndarray, span: float):
    """Adds the place on the curve: the bits of the chosen coordinates in turn, all in units of the longest extent."""

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = ((matrix(batch.column("vec"))[:, dims] - low) / span * (2**CURVE_BITS - 1)).astype(np.int64)
            key = np.zeros(len(batch), dtype=np.int64)
            for bit in reversed(range(CURVE_BITS)):
                for j in range(len(dims)):
                    key = key << 1 | steps[:, j] >> bit & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    return curve


def _cells(cell_rows: int):
    """Cuts a sorted partition into cells of at least ``cell_rows`` and less than twice as many rows, unless it has fewer."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << BLOCK_BITS
        held = None

        def cell(part: pa.Table) -> pa.Table:
            return part.append_column("cell", pa.array(np.full(len(part), number)))

        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while len(held) >= 2 * cell_rows:
                yield from cell(held.slice(0, cell_rows)).to_batches()
                held, number = held.slice(cell_rows), number + 1
        if held is not None and len(held):
            yield from cell(held).to_batches()

    return cells


def _within(min_samples: int):
    """How far the points of a cell have to look, by the cell alone, and its box in its first row."""

    def within(group: pa.Table) -> pa.Table:
        x, weight = matrix(group.column("vec")), group.column("weight").to_numpy()
        found = distances(x, x)
        order = found.argsort(axis=1, kind="stable")
        enough = np.cumsum(weight[order], axis=1) >= min_samples
        place = enough.argmax(axis=1)
        rows = np.arange(len(x))
        reach = np.where(enough[:, -1], found[rows, order[rows, place]], np.inf)
        box = [[side.tolist()] + [None] * (len(x) - 1) for side in (x.min(axis=0), x.max(axis=0))]
        kind = pa.list_(pa.float64())
        return pa.table(
            [*(group.column(c) for c in ("cell", "p", "vec", "weight")), pa.array(reach), pa.array(box[0], kind), pa.array(box[1], kind)],
            names=["cell", "p", "vec", "weight", "reach", "lo", "hi"],
        )

    return within


def _cell_pairs(cells: DataFrame, n_cells: int, fn, schema: str) -> DataFrame:
    """``fn`` on every pair of blocks of cells, the same one or of rising numbers."""
    blocks = -(-n_cells // CELL_BLOCK)
    own = F.pmod(F.xxhash64("cell"), F.lit(blocks))
    left = cells.withColumn("_i", own).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(blocks - 1).cast("long"))))
    right = cells.select(*[F.col(c).alias(c) for c in cells.columns]).withColumn("_j", own).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_j"))))
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(fn, schema)


def _near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of cells of which one is within what the other needs, unless both lie in one component."""
    a, b = left.column("cell").to_numpy(), right.column("cell").to_numpy()
    lo_a, hi_a, lo_b, hi_b = (matrix(t.column(c)) for t in (left, right) for c in ("lo", "hi"))
    square = np.zeros((len(a), len(b)))
    for j in range(lo_a.shape[1]):
        gap = np.maximum(lo_a[:, j, None] - hi_b[None, :, j], lo_b[None, :, j] - hi_a[:, j, None])
        square += np.maximum(gap, 0.0) ** 2
    at_least = np.sqrt(square) * (1 - SLACK)
    core_a, core_b, need_a, need_b, one_a, one_b = (t.column(c).to_numpy() for c in ("core", "need", "one") for t in (left, right))
    at_least = np.maximum(at_least, np.maximum(core_a[:, None], core_b[None, :]))
    wanted = at_least <= np.maximum(need_a[:, None], need_b[None, :])
    wanted &= (one_a[:, None] != one_b[None, :]) | (one_a[:, None] < 0)
    if key[0].as_py() == key[1].as_py():
        wanted &= a[:, None] < b[None, :]
    i, j = np.nonzero(wanted)
    return pa.table([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], names=["a", "b"])


def _met(points: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on the points of two blocks, or of one, and the pairs of cells in them that are to meet."""
    dealt = pairs.withColumns({"_i": F.shiftright("a", BLOCK_BITS), "_j": F.shiftright("b", BLOCK_BITS)})
    ends = dealt.select(F.col("_i").alias("_i"), F.col("_j").alias("_j")).distinct().withColumn("_at", F.explode(F.array_distinct(F.array("_i", "_j"))))
    rows = points.join(ends, F.shiftright("cell", BLOCK_BITS) == F.col("_at")).drop("_at")
    return rows.groupBy("_i", "_j").cogroup(dealt.groupBy("_i", "_j")).applyInArrow(fn, schema)


def _cells_of(points: pa.Table, pairs: pa.Table) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """For every pair of cells whether they are the same one, and the rows of either."""
    cell = points.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    found, first = np.unique(cell[order], return_index=True)
    rows = dict(zip(found.tolist(), np.split(order, first[1:]), strict=True))
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        yield a == b, rows[a], rows[b]


# -- core distances -------------------------------------------------------------


def _nearest(min_samples: int):
    """Of every point the nearest ones within its reach, as many as may matter."""

    def close(square: np.ndarray, off: float, far: np.ndarray) -> np.ndarray:
        found = square <= (far * far * (1 + SLACK) + off)[:, None]
        if square.shape[1] > min_samples and np.count_nonzero(found) > 8 * min_samples * len(square):
            last = np.partition(square, min_samples - 1, axis=1)[:, min_samples - 1]
            found &= square <= (last * (1 + SLACK) + 2 * off)[:, None]
        return found

    def least(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``at, to, d`` of the nearest of every point, and which of these is the last that is wanted."""
        at, to, d = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((d, at))
        at, to, d = at[order], to[order], d[order]
        # Every one weighs 1 at least: the first of a point's are enough.
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        keep = place < min_samples
        return at[keep], to[keep], d[keep], place[keep] == min_samples - 1

    def nearest(key: tuple, points: pa.Table, pairs: pa.Table) -> pa.Table:
        p, reach, weight = (points.column(c).to_numpy() for c in ("p", "reach", "weight"))
        vec, reach = matrix(points.column("vec")), reach.copy()
        parts, more = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for same, a, b in _cells_of(points, pairs):
            x, y = vec[a], vec[b]
            square, off = _squares(x, y)
            near_a = close(square, off, reach[a])
            near_b = np.zeros_like(near_a) if same else close(square.T, off, reach[b]).T
            i, j = np.nonzero(near_a | near_b)
            d = _between_rows(x, y, i, j)
            for at, to, of in ((a[i], b[j], near_a[i, j]), (b[j], a[i], near_b[i, j])):
                of &= d <= reach[at]
                parts.append((at[of], to[of], d[of]))
                more += len(parts[-1][0])
            if more > NEAR_PAIRS:
                at, to, d, last = least(parts)
                reach[at[last]] = np.minimum(reach[at[last]], d[last])
                parts, more = [(at, to, d)], 0
        at, to, d, _ = least(parts)
        return pa.table([pa.array(c) for c in (p[at], d, weight[to], p[to])], names=["p", "d", "weight", "q"])

    return nearest


def _cored(folded: DataFrame, n: int, min_samples: int, cell_rows: int, listed: int = 0) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """Points with their cells and core distances, the cells with their boxes, and the number of cells.

    With ``listed``, also the edges ``cu, cv, w, u, v`` from every point to so many that are nearest to it, and with the points
    ``beyond``: no edge of a point that is not among them is shorter.
    """
    most = max(min_samples, listed)
    extents = folded.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("dim").collect()
    low, span = np.array([r["low"] for r in extents]), np.array([r["high"] - r["low"] for r in extents])  # a number per dimension
    dims = [int(j) for j in np.argsort(-span, kind="stable")[:CURVE_DIMS] if span[j] > 0]
    keyed = folded.select("p", "vec", "weight").mapInArrow(_curve(dims, low[dims], span.max(initial=0.0)), "p long, vec array<double>, weight long, key long")
    parts = max(1, n // (BLOCK_CELLS * cell_rows), min(BLOCKS, n // (2 * cell_rows)))
    ranged = keyed.repartitionByRange(parts, "key", "p").sortWithinPartitions("key", "p")
    celled = settle(ranged.mapInArrow(_cells(cell_rows), "p long, vec array<double>, weight long, key long, cell long"), "cluster-cells")
    points = settle(celled.groupBy("cell").applyInArrow(_within(most), POINT), "cluster-points")
    boxes = settle(points.filter("lo is not null").select("cell", "lo", "hi"), "cluster-boxes")
    n_cells = boxes.count()
    need = points.groupBy("cell").agg(F.max("reach").alias("need"))
    cells = boxes.join(need, "cell").withColumns({"core": F.lit(0.0), "one": F.lit(-1).cast("long")})
    same = boxes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    pairs = settle(_cell_pairs(cells, n_cells, _near, "a long, b long").unionByName(same), "cluster-pairs")
    bare = points.drop("lo", "hi")
    found = _met(bare, pairs, _nearest(most), "p long, d double, weight long, q long")
    nearest = W.partitionBy("p").orderBy("d", "q").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("_sum", F.sum("weight").over(nearest))
    if listed:
        rank = F.row_number().over(W.partitionBy("p").orderBy("d", "q"))
        found = settle(found.withColumn("_rank", rank).filter(F.col("_rank") <= most), "cluster-nearest")
    cores = found.filter(F.col("_sum") >= min_samples).groupBy("p").agg(F.min("d").alias("core"))
    cored = bare.join(cores.withColumnRenamed("p", "_p"), F.col("p") == F.col("_p")).drop("_p")
    if not listed:
        return settle(cored.drop("reach").withColumn("comp", F.col("p")), "cluster-cored"), boxes, n_cells, None
    last = found.groupBy(F.col("p").alias("_p")).agg(F.count("*").alias("_n"), F.max("d").alias("_d"))
    beyond = F.when(F.col("_n") >= most, F.col("_d")).otherwise(F.col("reach")).alias("beyond")
    cored = cored.join(last, F.col("p") == F.col("_p")).select("cell", "p", "vec", "weight", "core", beyond, F.col("p").alias("comp"))
    cored = settle(cored, "cluster-cored")
    ends = [cored.select(F.col("p").alias(c), F.col("core").alias(f"_core_{c}")) for c in "uv"]
    edges = found.filter("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "d").distinct()
    edges = edges.join(ends[0], "u").join(ends[1], "v").withColumn("w", F.greatest("d", "_core_u", "_core_v"))
    return cored, boxes, n_cells, settle(edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "w", "u", "v"), "cluster-listed")


# -- the tree -------------------------------------------------------------------


def _firsts(comp: np.ndarray, other: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    """Of each component the first edge by weight, smaller and greater point."""
    order = np.lexsort((v, u, w, comp))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.diff(comp[order]) != 0
    return pa.table([pa.array(c[order[fresh]]) for c in (comp, other, w, u, v)], names=["comp", "other", "w", "u", "v"])


def _edges(points: pa.Table, known: np.ndarray | None, cells: Iterator[tuple[bool, np.ndarray, np.ndarray]]) -> pa.Table:
    """The first edge out of every component by the pairs of cells, but for edges longer than those ``known`` of the points' components."""
    p, core, comp = (points.column(c).to_numpy() for c in ("p", "core", "comp"))
    vec = matrix(points.column("vec"))
    level = core * core
    comps, own = np.unique(comp, return_inverse=True)
    best = np.full(len(comps), np.inf)  # squares that the first edges are not above
    if known is not None:
        np.minimum.at(best, own, known * known * (1 + SLACK))
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for same, a, b in cells:
        x, y, own_a, own_b = vec[a], vec[b], own[a], own[b]
        square, off = _squares(x, y)
        np.maximum(square, level[a][:, None], out=square)
        np.maximum(square, level[b][None, :], out=square)
        square[own_a[:, None] == own_b[None, :]] = np.inf
        np.minimum.at(best, own_a, square.min(axis=1) * (1 + SLACK) + off)
        if not same:
            np.minimum.at(best, own_b, square.min(axis=0) * (1 + SLACK) + off)
        limit = best * (1 + SLACK) + off
        if same:
            open_ = square <= limit[own_a][:, None]
        else:
            open_ = square <= np.maximum(limit[own_a][:, None], limit[own_b][None, :])
        open_ &= np.isfinite(square)
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        w = np.maximum(_between_rows(x, y, i, j), np.maximum(core[a[i]], core[b[j]]))
        p_i, p_j = p[a[i]], p[b[j]]
        low, high = np.minimum(p_i, p_j), np.maximum(p_i, p_j)
        found = [(comp[a[i]], comp[b[j]], w, low, high), (comp[b[j]], comp[a[i]], w, low, high)]
        for side in found:
            parts.append(tuple(c.to_numpy() for c in _firsts(*side).columns))
    return _firsts(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _shortest(key: tuple, points: pa.Table, pairs: pa.Table) -> pa.Table:
    return _edges(points, points.column("known").to_numpy(), _cells_of(points, pairs))


def _between(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Per component the shortest edge between points that stand for their cells: no shortest edge is longer."""
    n, every = len(left), len(left) + len(right)
    both = pa.table({c: pa.chunked_array([*left.column(c).chunks, *right.column(c).chunks]) for c in ("p", "vec", "core", "comp")})
    same = key[0].as_py() == key[1].as_py()
    runs = [[np.arange(i, min(i + CELL_ROWS, end)) for i in range(start, end, CELL_ROWS)] for start, end in ((0, n), (0, n) if same else (n, every))]
    parts = [(same and i == j, a, b) for i, a in enumerate(runs[0]) for j, b in enumerate(runs[1]) if not same or i <= j]
    return _edges(both, None, iter(parts)).select(["comp", "w"])


def _alone(key: tuple, group: pa.Table) -> pa.Table:
    rows = np.arange(len(group))
    return _edges(group, None, iter([(True, rows, rows)]))


def _first(edges: DataFrame) -> DataFrame:
    first = edges.groupBy("comp").agg(F.min(F.struct("w", "u", "v", "other")).alias("_e"))
    return settle(first.select("comp", "_e.*"), "cluster-first")


def _open(points: DataFrame, known: DataFrame) -> DataFrame:
    """Points that may have an edge which is not listed and no longer than the one ``known`` of their component."""
    bounds = known.select(F.col("comp").alias("_comp"), F.col("w").alias("known"))
    marked = points.join(bounds, F.col("comp") == F.col("_comp"), "left").drop("_comp").withColumn("known", F.coalesce("known", F.lit(math.inf)))
    return marked.filter(F.col("beyond") * (1 - SLACK) <= F.col("known"))


def _first_edges(points: DataFrame, boxes: DataFrame, n_cells: int, edges: DataFrame | None = None) -> DataFrame:
    """``comp, w, u, v, other``: the first edge out of every component.

    With ``edges``, the listed ones between components: an edge that is not listed is no shorter than what is ``beyond`` the
    lists of both its ends. Where none can be as short as the one that its component has, the lists are enough; else
    those points alone meet that such an edge may join.
    """
    listed = None
    if edges is not None:
        ways = [edges.select(F.col(a).alias("comp"), F.col(b).alias("other"), "w", "u", "v") for a, b in (("cu", "cv"), ("cv", "cu"))]
        listed = _first(ways[0].unionByName(ways[1]))
        if _open(points, listed).isEmpty():
            return listed
    found = points.groupBy("cell").applyInArrow(_alone, EDGE)
    if listed is not None:
        found = found.unionByName(listed)
    if n_cells > 1:
        found = settle(found, "cluster-own")
        stand = F.min_by(F.struct("p", "vec", "core", "comp"), F.struct("core", "p"))
        cells = points.groupBy("cell").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most"), stand.alias("_s"))
        cells = settle(cells, "cluster-state")
        stands = cells.select("cell", "_s.*")
        known = _cell_pairs(stands, n_cells, _between, "comp long, w double").unionByName(found.select("comp", "w"))
        known = settle(known.groupBy("comp").agg(F.min("w").alias("w")), "cluster-known")
        reached = known.select(F.col("comp").alias("_comp"), F.col("w").alias("known"))
        marked = points.join(reached, F.col("comp") == F.col("_comp"), "left").drop("_comp").withColumn("known", F.coalesce("known", F.lit(math.inf)))
        need = points.select("cell", "comp").distinct().join(known, "comp").groupBy("cell").agg(F.max("w").alias("need"))
        if listed is not None:
            need = settle(_open(points, known).groupBy("cell").agg(F.max("known").alias("need")), "cluster-need")
            most = need.agg(F.max("need")).first()[0]
            if most is None:
                return _first(found)
            marked = settle(marked.filter(F.col("beyond") * (1 - SLACK) <= most).drop("beyond"), "cluster-open")
            # A cell without such points needs nothing by itself.
            need = marked.select("cell").distinct().join(need, "cell", "left").withColumn("need", F.coalesce("need", F.lit(-1.0)))
        one = F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(F.lit(-1)).alias("one")
        bounds = cells.select("cell", F.col("_s.core").alias("core"), one).join(need, "cell").join(boxes, "cell")
        pairs = settle(_cell_pairs(bounds, n_cells, _near, "a long, b long"), "cluster-pairs")
        found = found.unionByName(_met(marked, pairs, _shortest, EDGE))
    return _first(found)


def _merged(points: DataFrame, roots: DataFrame) -> DataFrame:
    """Points with the components that theirs have become part of."""
    kept = [c for c in points.columns if c != "comp"]
    moved = points.join(roots, F.col("comp") == F.col("_node")).select(*kept, F.col("_root").alias("comp"))
    return settle(moved, "cluster-points")


def _still_out(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """Listed edges between the components that theirs have become part of."""
    ends = [roots.select(F.col("_node").alias(c), F.col("_root").alias(f"_{c}")) for c in ("cu", "cv")]
    moved = listed.join(ends[0], "cu").join(ends[1], "cv").filter("_cu <> _cv")
    return settle(moved.select(F.col("_cu").alias("cu"), F.col("_cv").alias("cv"), "w", "u", "v"), "cluster-listed")


def _joined(first: DataFrame) -> DataFrame:
    """``_node, _root``: first edges joined up. Each leads to one component, and of every tree two lead to each other: the smaller is its root; ways double."""
    back = first.select(F.col("comp").alias("_c"), F.col("other").alias("_o"))
    root = (F.col("_o") == F.col("comp")) & (F.col("comp") < F.col("other"))
    ways = first.join(back, F.col("other") == F.col("_c")).select(F.col("comp").alias("_node"), F.when(root, F.col("comp")).otherwise(F.col("other")).alias("_root"))
    while True:
        ways = settle(ways, "cluster-roots")
        on = ways.select(F.col("_node").alias("_at"), F.col("_root").alias("_to"))
        longer = ways.join(on, F.col("_root") == F.col("_at"))
        if longer.filter("_to <> _root").isEmpty():
            return ways
        ways = longer.select("_node", F.col("_to").alias("_root"))


def span(folded: DataFrame, n: int, min_samples: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct points (``p``, ``core``) and the edges (``u, v, w``) of the tree, without its hierarchy."""
    points, boxes, n_cells, listed = _cored(folded, n, min_samples, cell_rows, LISTED)
    cores = points.select("p", "core")
    edges = folded.sparkSession.createDataFrame([], "u long, v long, w double")
    left = n
    while left > 1:
        first = _first_edges(points, boxes, n_cells, listed)
        edges = edges.unionByName(first.select("u", "v", "w").distinct())
        roots = _joined(first)
        left = roots.filter("_node = _root").count()
        if left > 1:
            points, listed = _merged(points, roots), _still_out(listed, roots)
    return cores, settle(edges, "cluster-edges")


# -- the condensed hierarchy ----------------------------------------------------


def _score(mass: Column, size: Column, density: Column, below: Column) -> tuple[Column, Column]:
    """Stability of a cluster that ends, upwards, at ``density``; and whether it counts more than its descendants."""
    stability = mass - size * density
    return stability, stability >= below * (1 - SAME_SCORE)


def _in_order(joins: DataFrame) -> DataFrame:
    """Joins with ``_n``, the size that their component has grown to before: running sums inside range partitions, shifted by the sums of those before."""
    parts = max(1, int(joins.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = joins.repartitionByRange(parts, "root", "w", "u", "v", "piece").withColumn("_part", F.spark_partition_id())
    ranged = settle(ranged, "cluster-joins")
    before = W.partitionBy("root").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("root", "_part").agg(F.sum("size").alias("_sum"))
    starts = sums.select(F.col("root").alias("_r"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    ahead = W.partitionBy("root", "_part").orderBy("w", "u", "v", "piece").rowsBetween(W.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    joined = inside.join(starts, (F.col("root") == F.col("_r")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_n", F.col("_inside") + F.col("_start")).drop("_inside", "_start", "_r", "_p")


def _condense(joins: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """What follows from the joins of some components: each piece's share in the clusters of its component, and those clusters in order.

    A row of ``joins`` is a ``piece`` that joins component ``root`` by the edge ``w, u, v``, with its ``size``, its top cluster ``top`` (null below
    ``least`` points), the ``mass`` of that (densities at which points leave it, added up) and the score ``below`` it.
    """
    density = 1 / F.greatest("w", F.lit(LEAST_LEVEL))
    rows = _in_order(joins).withColumns({"_at": density, "_big": F.col("size") >= least})
    grown = F.col("_n") >= least
    edge = F.concat_ws("-", "u", "v")
    split = grown & F.col("_big")
    born = ~grown & ~F.col("_big") & (F.col("_n") + F.col("size") >= least)
    taken = ~grown & F.col("_big")  # a large first piece among them: nothing is before it
    every = (F.col("_n") + F.col("size")) * F.col("_at")
    rows = rows.withColumns(
        {
            "_split": split,
            "_starts": F.when(split | born, edge).when(taken, F.col("top")),
            "_adds": F.when(split | born, every).when(taken, F.col("mass") + F.col("_n") * F.col("_at")).when(grown, F.col("size") * F.col("_at")).otherwise(0.0),
            "_under": F.when(taken, F.col("below")),
        }
    )
    rows = settle(rows, "cluster-rows")
    # The rows that start a cluster, in order: a piece of any size belongs to the last of them before it, or to the first.
    order = W.partitionBy("root").orderBy("w", "u", "v", "piece")
    stability, counts = _score(F.col("mass"), F.col("size"), F.col("_at"), F.col("below"))
    entered = F.when(F.col("_split"), F.struct(F.col("top").alias("top"), F.greatest(stability, F.col("below")).alias("score"), counts.alias("counts")))
    starts = rows.filter("_starts is not null").withColumn("_seg", F.row_number().over(order))
    edges = F.struct("w", "u", "v", "piece")
    starts = starts.select("root", "_seg", F.col("_starts").alias("cluster"), "_n", "_at", "_under", entered.alias("_joined"), edges.alias("_from"))
    chain = W.partitionBy("root").orderBy("_seg")
    starts = starts.withColumns({"_to": F.lead("_from").over(chain), "_next": F.lead("cluster").over(chain), "_end": F.lead("_n").over(chain), "_end_at": F.lead("_at").over(chain)})
    starts = settle(starts, "cluster-starts")
    return rows, starts


def _shares(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with the cluster of the chain that they count for."""
    spans = starts.select(F.col("root").alias("_r"), "cluster", "_seg", "_from", "_to")
    at = F.struct("w", "u", "v", "piece")
    first = (F.col("_seg") == 1) & (at < F.col("_from"))
    inside = (at >= F.col("_from")) & (F.col("_to").isNull() | (at < F.col("_to")))
    return rows.join(spans, (F.col("root") == F.col("_r")) & (first | inside), "left").drop("_r", "_from", "_to")


def _chain(shares: DataFrame, starts: DataFrame) -> DataFrame:
    """The clusters of the chains with their masses, what lies below each, and whether it counts more than that."""
    masses = shares.filter("cluster is not null").groupBy("root", "_seg").agg(F.sum("_adds").alias("mass"))
    chain = W.partitionBy("root").orderBy("_seg")
    upto, before = chain.rowsBetween(W.unboundedPreceding, 0), chain.rowsBetween(W.unboundedPreceding, -1)
    rows = starts.join(masses, ["root", "_seg"])
    # Below a cluster lies the best of the cluster before it plus what joined: sums of what joined, and the greatest lead over them.
    rows = rows.withColumns({"_sum": F.sum(F.coalesce("_joined.score", F.lit(0.0))).over(upto), "_stability": F.col("mass") - F.col("_end") * F.col("_end_at")})
    under = F.coalesce(F.first("_under").over(upto), F.lit(0.0))  # what lay below the first piece's cluster
    lead = F.greatest(F.max(F.col("_stability") - F.col("_sum")).over(before), under)
    rows = rows.withColumn("below", F.when(F.col("_seg") == 1, under).otherwise(F.col("_sum") + lead))
    return rows.withColumn("_counts", F.col("_stability") >= F.col("below") * (1 - SAME_SCORE))


@dataclass
class Hierarchy:
    """Distinct points (``p``, ``core``), the cluster that each leaves (``p``, ``fell``), tree edges, and clusters with their parents."""

    points: DataFrame
    members: DataFrame
    edges: DataFrame
    clusters: DataFrame


def grow(folded: DataFrame, n: int, min_samples: int, min_cluster_size: int, cell_rows: int, single: bool) -> Hierarchy:
    """The rounds over distinct points ``p, vec, weight`` whose coordinates are at most 1; together they weigh ``min_samples`` at least."""
    spark = folded.sparkSession
    points, boxes, n_cells, listed = _cored(folded, n, min_samples, cell_rows, LISTED)
    cores = points.select("p", "core")
    large = F.col("weight") >= min_cluster_size
    name = F.col("p").cast("string")
    mass = F.when(large, F.col("weight") / F.greatest("core", F.lit(LEAST_LEVEL))).otherwise(0.0)
    state = points.select(F.col("p").alias("comp"), F.col("weight").alias("size"), F.when(large, name).alias("top"), mass.alias("mass"), F.lit(0.0).alias("below"))
    members = points.filter(large).select("p", name.alias("fell"))
    open_points = points.filter(~large).select("p", F.col("p").alias("piece"))
    edges = spark.createDataFrame([], "u long, v long, w double")
    clusters = spark.createDataFrame([], "cluster string, parent string, counts boolean")
    waiting = spark.createDataFrame([], "root long, w double, u long, v long, piece long, size long, top string, mass double, below double")
    left, first_round = n, True
    while True:
        first = _first_edges(points, boxes, n_cells) if left > 1 else spark.createDataFrame([], "comp long, w double, u long, v long, other long")
        if not first_round:
            # Joins shorter than their component's next edge are due; the others wait.
            ends = first.select(F.col("comp").alias("_comp"), F.struct("w", "u", "v").alias("_edge"))
            known = waiting.join(ends, F.col("root") == F.col("_comp"), "left")
            due = F.col("_edge").isNull() | (F.struct("w", "u", "v") < F.col("_edge"))
            rows, starts = _condense(known.filter(due).drop("_comp", "_edge"), min_cluster_size)
            shares = settle(_shares(rows, starts).select("root", "piece", "size", "_big", "_adds", "cluster", "_seg"), "cluster-shares")
            chain = settle(_chain(shares, starts), "cluster-chain")
            ended = chain.filter("_next is not null").select("cluster", F.col("_next").alias("parent"), F.col("_counts").alias("counts"))
            entered = chain.filter("_joined is not null").select(F.col("_joined.top").alias("cluster"), F.col("cluster").alias("parent"), F.col("_joined.counts").alias("counts"))
            clusters = clusters.unionByName(ended).unionByName(entered)
            last = chain.filter("_next is null").select("root", F.col("cluster").alias("top"), "mass", "below")
            sizes = shares.groupBy("root").agg(F.sum("size").alias("size"))
            told = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mass", "below")]
            state = settle(sizes.join(last, "root", "left").select(F.col("root").alias("comp"), "size", "top", *told), "cluster-state")
            # Points of small pieces leave the cluster that these join, or are now of the piece that their component is.
            moved = shares.filter("not _big").select(F.col("piece").alias("_piece"), "root", F.col("cluster").alias("fell"))
            moved = open_points.join(moved, F.col("piece") == F.col("_piece"), "left")
            moved = settle(moved.select("p", F.coalesce("root", "piece").alias("piece"), "fell"), "cluster-members")
            members = members.unionByName(moved.filter("fell is not null").select("p", "fell"))
            open_points = moved.filter("fell is null").select("p", "piece")
            waiting = known.filter(~due).drop("_comp", "_edge")
        if left <= 1:
            break
        edges = edges.unionByName(first.select("u", "v", "w").distinct())
        roots = _joined(first)
        joining = first.drop("other").join(state, "comp").join(roots, F.col("comp") == F.col("_node"))
        joining = joining.select(F.col("_root").alias("root"), "w", "u", "v", F.col("comp").alias("piece"), "size", "top", "mass", "below")
        again = waiting.join(roots, F.col("root") == F.col("_node")).select(F.col("_root").alias("root"), *waiting.columns[1:])
        waiting = settle(joining.unionByName(again), "cluster-waiting")
        points = _merged(points, roots)
        left, first_round = roots.select("_root").distinct().count(), False
    counts = F.col("mass") >= F.col("below") * (1 - SAME_SCORE) if single else F.lit(False)
    top = state.filter("top is not null").select(F.col("top").alias("cluster"), F.lit(None).cast("string").alias("parent"), counts.alias("counts"))
    clusters = settle(clusters.unionByName(top), "cluster-clusters")
    return Hierarchy(cores, members, settle(edges, "cluster-edges"), clusters)


def chosen(clusters: DataFrame) -> DataFrame:
    """``cluster, best``: of every cluster the topmost one that counts among itself and its ancestors, or null; by doubling steps."""
    ways = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("counts"), F.col("cluster")).alias("best"))
    while True:
        ways = settle(ways, "cluster-ways")
        if ways.filter("up is not null").isEmpty():
            return ways.select("cluster", "best")
        above = ways.select(F.col("cluster").alias("_at"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        ways = ways.join(above, F.col("up") == F.col("_at"), "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_best", "best").alias("best"))


def _numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with ``p``, its place from 0 in the order of ``by``: places inside range partitions, shifted by the rows of those before."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settle(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "cluster-order")
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    sizes = ranged.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_many"))
    starts = sizes.select("_p", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    inside = ranged.withColumn("_inside", F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1)
    joined = inside.join(bounded_broadcast(starts, parts), F.col("_part") == F.col("_p"))
    return joined.withColumn("p", F.col("_inside") + F.col("_start")).drop("_part", "_p", "_start", "_inside")


def _prepared(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, float, int, int]:
    """Rows with the digest of their vector (null for unusable ones), distinct points in units of ``scale``, and how many there are, with and without copies."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    good = F.coalesce(F.col(id_col).isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.when(good, vec).alias("_vec"))
    rows = settle(rows.withColumn("_digest", F.md5(F.col("_vec").cast("string"))), "cluster-rows")
    usable = rows.filter("_vec is not null")
    top = F.max(F.array_max(F.transform("_vec", F.abs)))
    seen = usable.agg(top.alias("top"), F.min(F.size("_vec")).alias("low"), F.max(F.size("_vec")).alias("high")).first()
    if seen["low"] != seen["high"]:
        raise ValueError("vectors differ in length")
    # A power of two, so that scaling is exact and squares neither vanish nor overflow.
    scale = 2.0 ** max(-1021, math.frexp(seen["top"])[1]) if seen["top"] else 1.0
    folded = usable.groupBy("_digest").agg(F.min("_id").alias("_first"), F.first("_vec").alias("vec"), F.count("*").alias("weight"))
    folded = folded.withColumn("vec", F.transform("vec", lambda x: x / F.lit(scale)))
    folded = settle(_numbered(folded, ["_first", "_digest"]), "cluster-folded")
    told = folded.agg(F.count("*").alias("n"), F.sum("weight").alias("all")).first()
    return rows, folded, scale, told["n"], told["all"] or 0


def reachability_tree(df: DataFrame, id_col: str, vec_col: str, min_samples: int = 5, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``u, v, weight``: a minimum spanning tree of the mutual reachability distances, ``u <= v``, one edge less than there are vectors.

    Of edges of equal weight, those of smaller ids come first; copies hang on
    the smallest of them. Ids are whole numbers; where different vectors share one, so do their edges' ends. Rows with a null id or a null, empty or non-finite
    vector are left out. With fewer than ``min_samples`` rows no point has a core distance, and there is no edge.
    """
    rows, folded, scale, n, every = _prepared(df, id_col, vec_col)
    if every < min_samples:
        return df.sparkSession.createDataFrame([], "u long, v long, weight double")
    points, edges = span(folded.drop("_digest", "_first"), n, min_samples, cell_rows)
    firsts = folded.select(F.col("p").alias("_p"), "_digest", "_first")
    ends = [firsts.select(F.col("_p").alias(f"_{c}"), F.col("_first").alias(f"_id_{c}")) for c in "uv"]
    named = edges.join(ends[0], F.col("u") == F.col("_u")).join(ends[1], F.col("v") == F.col("_v"))
    tree = named.select(F.col("_id_u").alias("u"), F.col("_id_v").alias("v"), "w")
    # Every further copy hangs on the first, whose id may be its own.
    cores = points.join(firsts, F.col("p") == F.col("_p")).drop("_p")
    again = rows.filter("_vec is not null").groupBy("_digest", "_id").agg(F.count("*").alias("_many"))
    extra = F.col("_many") - F.when(F.col("_id") == F.col("_first"), 1).otherwise(0)
    copies = again.join(cores, "_digest").withColumn("_extra", extra).filter("_extra > 0")
    copies = copies.select(F.col("_first").alias("u"), F.col("_id").alias("v"), F.col("core").alias("w"), F.explode(F.sequence(F.lit(1).cast("long"), "_extra")).alias("_k"))
    return tree.unionByName(copies.drop("_k")).select("u", "v", (F.col("w") * scale).alias("weight"))


def hierarchical_cluster(
    df: DataFrame, id_col: str, vec_col: str, min_cluster_size: int = 5, min_samples: int | None = None, single: bool = False, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``(id, cluster)`` for every row: clusters of at least ``min_cluster_size`` points that last longest, -1 for noise.

    A cluster lasts over the densities at which its points stay together; it is
    kept if that adds up to at least as much as its descendants do, and the one that
    holds all points only with ``single``. ``min_samples`` is ``min_cluster_size``
    unless given. Clusters are numbered by their smallest ids, which are whole numbers.

    Copies of a vector are one point that weighs as many. Rows with a null id or
    a null, empty or non-finite vector are noise; vectors of different lengths are
    an error. Distances below a billionth of the largest coordinate count as that.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")
    min_samples = min_samples or min_cluster_size
    rows, folded, _, n, every = _prepared(df, id_col, vec_col)
    if every < max(min_samples, min_cluster_size):
        return rows.select(F.col("_id").alias(id_col), F.lit(-1).alias("cluster"))
    grown = grow(folded.drop("_digest", "_first"), n, min_samples, min_cluster_size, cell_rows, single)
    best = chosen(grown.clusters).filter("best is not null")
    member = grown.members.join(best, F.col("fell") == F.col("cluster")).select("p", "best")
    member = settle(member, "cluster-members")
    least = settle(member.groupBy("best").agg(F.min("p").alias("root")), "cluster-least")  # places follow the ids
    numbers = least.join(dense_rank_ids(least, "root"), "root").select(F.col("best").alias("_best"), "cluster")
    digests = folded.select(F.col("p").alias("_p"), F.col("_digest").alias("_key"))
    labels = member.join(numbers, F.col("best") == F.col("_best")).join(digests, F.col("p") == F.col("_p")).select("_key", "cluster")
    return rows.join(labels, F.col("_digest") == F.col("_key"), "left").select(F.col("_id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
