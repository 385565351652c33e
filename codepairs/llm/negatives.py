"""Hard negatives: for an anchor and each of its best positives, the best rows of other labels whose score lies in a window below the positive's.

Scores are inner products of whole numbers. Anchors are cut into blocks, and the
anchors of a block are joined by spanning trees of short edges (Prim's
algorithm). A tile holds a block of anchors and a block of candidates and walks the
trees from their roots: a candidate ``c`` whose score with the parent lies in an
interval scores with the child within that interval widened on both sides by
``|child - parent| |c|``. Only candidates whose interval meets what is asked for
are scored again; the others pass their wider interval on to the child's children.

Two passes ask: the first for the best rows of the anchor's own label, so an
interval must reach the score of the last of those found so far; the second for
rows of other labels inside a window, so it must meet a window above the last
found there. A tile passes on what a few rows per anchor can hold, and heaps
merge the tiles. Blocks are cut by a digest of the row, so no label and no
cluster of copies makes a block larger.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.llm.registry import query, table
from codepairs.session import settle

# Numbers in a block of anchors or of candidates at most, and rows of a candidate block at least.
BLOCK_NUMBERS = 1 << 22
LEAST_ROWS = 4096
# Anchors of one spanning tree, and candidates that walk it at once.
TREE_ROWS = 1024
SLICE_NUMBERS = 1 << 19

FOUND = "row long, slot int, id long, score string"
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.string())


def is_finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def exact_limit(dim: int, scale: int) -> float:
    """Vectors whose components stay below it have products that doubles hold exactly, with room for bounds."""
    return math.isqrt((1 << 51) // max(dim, 1)) / scale


def whole(table: pa.Table, dim: int, scale: int, wide: bool) -> np.ndarray:
    """``floor(scale * x)`` of the column ``vec``: doubles, or with ``wide`` Python's whole numbers."""
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), dim)
    if not wide:
        return np.floor(flat * scale)
    numbers = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in flat.ravel().tolist()]
    return np.array([*numbers, None], dtype=object)[:-1].reshape(flat.shape)


def spanning_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree of short edges over the rows, in an order that has parents first: rows, the places of their parents (-1 for the root), and the lengths of the edges.

    Children with many descendants come last, so that a walk that forgets a row
    after its last child remembers few at a time.
    """
    n = len(rows)
    parent, gap = np.full(n, -1), np.full(n, np.inf)
    left, joined, at = np.ones(n, dtype=bool), [], 0
    for _ in range(n):
        left[at] = False
        joined.append(at)
        distance = np.linalg.norm(rows - rows[at], axis=1)
        nearer = left & (distance < gap)
        gap[nearer], parent[nearer] = distance[nearer], at
        at = int(np.where(left, gap, np.inf).argmin())
    children: list[list[int]] = [[] for _ in range(n)]
    size = np.ones(n, dtype=np.int64)
    for i in reversed(joined[1:]):
        size[parent[i]] += size[i]
        children[parent[i]].append(i)
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack.extend(sorted(children[i], key=lambda c: -size[c]))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    up = np.where(parent[order] < 0, -1, place[parent[order]])
    return np.array(order, dtype=np.int64), up, np.where(up < 0, 0.0, gap[order])


def _trees(dim_scale: int):
    def trees(key: tuple, group: pa.Table) -> pa.Table:
        """The anchors of a tree in the order of the walk, with parent and edge; wide ones are not joined."""
        dim, wide = key[0].as_py(), key[1].as_py()
        if wide:
            order, up, edge = np.arange(len(group)), np.full(len(group), -1), np.zeros(len(group))
        else:
            order, up, edge = spanning_tree(whole(group, dim, dim_scale, False))
        group = group.take(pa.array(order))
        # Lengths are rounded up.
        for name, values in (("step", np.arange(len(order))), ("parent", up), ("edge", edge * (1 + 1e-9))):
            group = group.append_column(name, pa.array(values))
        return group

    return trees


def walk(parent: np.ndarray, edge: np.ndarray, anchors: np.ndarray, rows: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each anchor in the order of the tree: the numbers of the rows that ``wanted(anchor, low, high)`` chose by their intervals, and their scores."""
    norms = np.linalg.norm(rows, axis=1) * (1 + 1e-9)
    last = np.full(len(parent), -1)
    last[parent[parent >= 0]] = np.flatnonzero(parent >= 0)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(parent)):
        if parent[i] < 0:
            low = high = rows @ anchors[i]
            chosen = np.flatnonzero(wanted(i, low, high))
            scores = low[chosen]
        else:
            above = known[parent[i]]
            reach = norms * edge[i] + 1  # more than the rounding of bounds below 2^52
            low, high = above[0] - reach, above[1] + reach
            if last[parent[i]] == i:
                del known[parent[i]]
            chosen = np.flatnonzero(wanted(i, low, high))
            # More than half of the rows are scored sooner in one product than picked out.
            scores = (rows @ anchors[i])[chosen] if 2 * len(chosen) > len(rows) else rows[chosen] @ anchors[i]
            low[chosen] = high[chosen] = scores
        if last[i] >= 0:
            known[i] = (low, high)
        yield i, chosen, scores


def _best(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the first ``k``, highest scores first, smaller ids before larger."""
    if len(scores) > 4 * k and scores.dtype != object:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)


class Heaps:
    """For each key the ``k`` first of what was offered."""

    def __init__(self, k: int):
        self.k = k
        self.heaps: dict[tuple, list[tuple[int, int, int]]] = {}
        self.turn = 0

    def offer(self, key: tuple, score: int, row_id: int) -> None:
        heap = self.heaps.setdefault(key, [])
        self.turn += 1  # equal rows are rows of their own
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -row_id, self.turn))
        elif (score, -row_id) > heap[0][:2]:
            heapq.heapreplace(heap, (score, -row_id, self.turn))

    def floor(self, key: tuple) -> float:
        """A row that scores less cannot enter."""
        heap = self.heaps.get(key, ())
        return heap[0][0] if len(heap) == self.k else -math.inf

    def firsts(self) -> Iterator[tuple[tuple, int, int, int]]:
        for key, heap in self.heaps.items():
            for rank, (score, row_id, _) in enumerate(sorted(heap, reverse=True), 1):
                yield key, rank, -row_id, score


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _scores(left: np.ndarray, rows: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``walk``, but every score is computed, in whole numbers of any size."""
    for i, anchor in enumerate(left):
        scores = rows @ anchor
        chosen = np.flatnonzero(wanted(i, scores, scores))
        yield i, chosen, scores[chosen]


def _search(k: int, scale: int, windows: bool, low_percent: int, high_percent: int):
    """What one block of candidates holds for one block of anchors."""

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, wide = key[0].as_py(), key[1].as_py()
        heaps = Heaps(k)
        if len(left) and len(right):
            left = left.sort_by([("tree", "ascending"), ("step", "ascending")])
            known = pc.unique(pa.concat_arrays([t.column("label").combine_chunks() for t in (left, right)]))
            l_label, r_label = (pc.index_in(t.column("label"), known).to_numpy() for t in (left, right))
            l_row, tree, parent, edge = (left.column(c).to_numpy() for c in ("row", "tree", "parent", "edge"))
            r_row, r_id = right.column("row").to_numpy(), right.column("vec_id").to_numpy()
            anchors = whole(left, dim, scale, wide)
            # Of each anchor: slot, and 100 times the least and the greatest score asked for.
            asked: list[list[tuple]] = [[(0, None, None)]] * len(left)
            if windows:
                asked = [[(s["slot"], low_percent * int(s["score"]), high_percent * int(s["score"])) for s in told] for told in left.column("positives").to_pylist()]
            cuts = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(left)]
            step = max(1, SLICE_NUMBERS // max(dim, 1))
            for at in range(0, len(right), step):
                rows = whole(right.slice(at, step), dim, scale, wide)
                label, row, ids = r_label[at : at + step], r_row[at : at + step], r_id[at : at + step]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):

                    def positives(i: int, low: np.ndarray, high: np.ndarray, a=a) -> np.ndarray:
                        fit = (label == l_label[a + i]) & (row != l_row[a + i])
                        least = heaps.floor((l_row[a + i], 0))
                        if fit.sum() > k and not wide:
                            least = max(least, np.partition(low[fit], -k)[-k])
                        return fit & (high >= least).astype(bool)

                    def negatives(i: int, low: np.ndarray, high: np.ndarray, a=a) -> np.ndarray:
                        meets = np.zeros(len(low), dtype=bool)
                        for slot, least, most in asked[a + i]:
                            if least <= most:
                                least = max(least, 100 * heaps.floor((l_row[a + i], slot)))
                                meets |= (100 * high >= least).astype(bool) & (100 * low <= most).astype(bool)
                        return meets & (label != l_label[a + i])

                    wanted = negatives if windows else positives
                    walked = _scores(anchors[a:b], rows, wanted) if wide else walk(parent[a:b], edge[a:b], anchors[a:b], rows, wanted)
                    for i, chosen, scores in walked:
                        for slot, least, most in asked[a + i]:
                            inside = np.arange(len(chosen))
                            if windows:
                                inside = np.flatnonzero((100 * scores >= least).astype(bool) & (100 * scores <= most).astype(bool))
                            for j in inside[_best(k, ids[chosen[inside]], scores[inside])].tolist():
                                heaps.offer((l_row[a + i], slot), int(scores[j]), int(ids[chosen[j]]))
        out = [(int(row), slot, row_id, str(score)) for (row, slot), _, row_id, score in heaps.firsts()]
        return _table(out, KINDS, ["row", "slot", "id", "score"])

    return search


def _merge(k: int):
    def merge(group: pa.Table) -> pa.Table:
        """The first of all tiles, for a bunch of anchors."""
        heaps = Heaps(k)
        for row, slot, row_id, score in zip(*(group.column(c).to_pylist() for c in ("row", "slot", "id", "score")), strict=True):
            heaps.offer((row, slot), int(score), row_id)
        out = [(row, slot, rank, row_id, str(score)) for (row, slot), rank, row_id, score in heaps.firsts()]
        return _table(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()), ["row", "slot", "rank", "id", "score"])

    return merge


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    block_numbers: int = BLOCK_NUMBERS,
    least_rows: int = LEAST_ROWS,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of ``floor(scale * x)`` of both vectors
    (``embedding``); higher ones come first, then smaller ids. The positives of an
    anchor are its first other rows of the same ``label``, and the negatives of a positive
    the first rows of another label whose score ``n`` holds ``low_percent * p <= 100 * n <=
    high_percent * p`` for the positive's score ``p``; a negative ``p`` has none.
    Every row is a candidate for every anchor: the result is complete.

    Rows with a null id, label or vector, or with a null or non-finite component
    take no part; zero vectors do. Vectors meet those of their own length only.
    Rows that repeat are rows of their own, also as positives and as anchors,
    and an anchor's own row is no candidate of it. Vectors with components too large for exact
    doubles are scored against all in Python's whole numbers; a score beyond a
    long keeps its place and is shown as null. Extra columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"), is_anchor.alias("_asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("vec"))).withColumn("dim", F.size("vec"))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "negative-rows")
    limits = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("_asks"), 1)).alias("asks")).collect()  # a row per length
    if not limits:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def by_dim(value: Callable[[int, int, int], float]) -> Column:
        cases = [F.when(F.col("dim") == r["dim"], F.lit(value(r["dim"], r["n"], r["asks"]))) for r in limits]
        return F.coalesce(*cases)

    def fit(dim: int) -> int:
        return max(1, block_numbers // max(dim, 1))

    # A block of candidates holds 16 times their root, so that tiles grow with the work, up to what memory allows.
    right_blocks = by_dim(lambda d, n, _: -(-n // min(max(least_rows, 16 * math.isqrt(n)), fit(d))))
    left_blocks = by_dim(lambda d, _, asks: max(1, -(-asks // fit(d))))
    trees = by_dim(lambda d, _, asks: max(1, -(-asks // min(tree_rows, fit(d)))))
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    wide = F.coalesce(largest >= by_dim(lambda d, n, _: exact_limit(d, scale)), F.lit(False))
    counted = {"wide": wide, "_n_i": left_blocks.cast("long"), "_n_j": right_blocks.cast("long")}
    rows = rows.withColumns(counted).withColumn("_spread", F.xxhash64("row"))
    asks = rows.filter("_asks").withColumn("tree", F.pmod("_spread", trees)).withColumn("_i", F.pmod("tree", "_n_i"))
    asks = asks.select("dim", "wide", "tree", "_i", "_n_j", "row", "vec_id", "label", "vec")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema.fields) + ", step long, parent long, edge double"
    anchors = settle(asks.groupBy("dim", "wide", "tree").applyInArrow(_trees(scale), schema), "negative-anchors")
    any_wide = not rows.filter("wide").isEmpty()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = rows.withColumn("_j", F.pmod("_spread", "_n_j")).withColumn("_i", every("_n_i"))
    keys = ["dim", "wide", "_i", "_j"]
    tiles = max(-(-r["n"] // least_rows) for r in limits)

    def found(left: DataFrame, k: int, windows: bool) -> DataFrame:
        search = _search(k, scale, windows, low_percent, high_percent)
        left = left.withColumn("_j", every("_n_j")).select(*keys, "tree", "step", "parent", "edge", "row", "label", "vec", *(["positives"] if windows else []))
        sides = [(left.filter("NOT wide"), right.filter("NOT wide"))]
        if any_wide:
            # All anchors against wide candidates, and wide anchors against the others.
            sides += [(left, right.filter("wide")), (left.filter("wide"), right.filter("NOT wide"))]
        hits = None
        for at, (a, b) in enumerate(sides):
            columns = [F.lit(at > 0).alias("wide") if c == "wide" else F.col(c).alias(c) for c in (*keys, "row", "vec_id", "label", "vec")]
            a = a.withColumn("wide", F.lit(at > 0))
            tile = a.groupBy(*keys).cogroup(b.select(*columns).groupBy(*keys)).applyInArrow(search, FOUND)
            hits = tile if hits is None else hits.unionByName(tile)
        # A bunch holds about a million rows, or one anchor's.
        slots = positives if windows else 1
        bunches = max(1, sum(r["asks"] for r in limits) * tiles * k * slots >> 20)
        bunched = hits.withColumn("_bunch", F.pmod(F.xxhash64("row"), F.lit(bunches)))
        return bunched.groupBy("_bunch").applyInArrow(_merge(k), "row long, slot int, rank int, id long, score string")

    best = settle(found(anchors, positives, False).select("row", F.col("rank").alias("slot"), "id", "score"), "negative-positives")
    told = best.groupBy("row").agg(F.collect_list(F.struct("slot", "id", "score")).alias("positives"))  # a few per anchor
    asking = settle(anchors.join(told, "row"), "negative-windows")
    hits = found(asking, negatives, True)
    near = best.select(F.col("row").alias("_row"), F.col("slot").alias("_slot"), F.col("id").alias("positive_id"), F.col("score").alias("_positive"))
    names = anchors.select(F.col("row").alias("_anchor"), F.col("vec_id").alias("anchor_id"))
    joined = hits.join(near, (F.col("row") == F.col("_row")) & (F.col("slot") == F.col("_slot"))).join(names, F.col("row") == F.col("_anchor"))
    return joined.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        F.col("_positive").try_cast("long").alias("positive_score"),
        F.col("score").try_cast("long").alias("negative_score"),
    )


def shifted(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` with the label of every so many ids moved on by one."""
    moved = (F.col("label").cast("long") + 1) % labels
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label").cast("long")))


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10"""


@query(SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives of each of the five best positives of every hundredth vector, among all vectors."""
    return hard_negatives(shifted(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)
