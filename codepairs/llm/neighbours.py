"""Nearest neighbours by a block matrix join of quantised vectors.

Queries and candidates are cut into blocks; every query block meets every
candidate block in one task. There both are rounded to signed bytes, one product
of the two byte matrices gives all inner products, and the known size of the
rounding errors turns them into a lower and an upper bound of each distance. A
candidate whose lower bound lies above the k-th smallest upper bound cannot be
among the nearest; the others are computed again from the original doubles. Each
tile passes on its k nearest per query, and the tiles are merged by heaps.

A tile is first scaled by a power of two, so that no square overflows; what then
vanishes only widens the bounds. Distances are scaled likewise where the plain sum
of squares would overflow or vanish.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.llm.vectors import doubles, is_valid, matrix
from codepairs.session import settle

# Rows of a block on either side, and of the slices a tile is worked off in.
TILE_ROWS = 8192
SLICE = 256

HITS = "query_id long, vec_id long, score double"


# Sums of squares outside these have lost digits, or all.
LEAST_SQUARE, MOST_SQUARE = 1e-280, 1e300
# Products of signed bytes add up exactly in single precision up to so many dimensions.
SINGLE_DIMS = 1000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as signed bytes (held as floats, whose products of bytes are exact), their scales, and the norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # a row that vanished beside the others: all of it is error
    codes = np.rint(x / scale[:, None])
    kind = np.float32 if x.shape[1] <= SINGLE_DIMS else np.float64
    return codes.astype(kind), scale, np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-9)


def tile(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, only: np.ndarray, k: int):
    """For each query the numbers of the rows that may be among its ``k`` nearest; a row that stands for the query's own id ``only`` is none."""
    _, power = np.frexp(max(np.abs(queries).max(initial=0.0), np.abs(rows).max(initial=0.0)))
    # In two steps, as a power of two may itself be out of range.
    half = int(power) // 2
    # From here on distances are infinite, so none is farther than another.
    farthest = np.ldexp(1 - 1e-6, 2 * (1024 - int(power))) if 2 * (1024 - int(power)) < 1024 else np.inf
    queries, rows = (np.ldexp(np.ldexp(x, -half), half - int(power)) for x in (queries, rows))
    q_codes, q_scale, q_error = quantise(queries)
    r_codes, r_scale, r_error = quantise(rows)
    q_norm, r_norm = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    r_near = r_norm + r_error  # no less than the norm of the rounded row
    for at in range(0, len(queries), SLICE):
        inner = q_codes[at : at + SLICE] @ r_codes.T
        for i, dots in enumerate(inner, at):
            square = q_norm[i] ** 2 + r_norm**2 - 2 * dots.astype(np.float64) * (r_scale * q_scale[i])
            slack = 2 * (q_error[i] * r_near + r_error * (q_norm[i] + 2 * q_error[i])) + 1e-9 * (q_norm[i] ** 2 + r_norm**2) + 1e-300
            upper = np.where(only == own[i], np.inf, square + slack)
            bound = np.partition(upper, k - 1)[k - 1] if len(rows) > k else np.inf
            yield i, np.flatnonzero((np.minimum(square - slack, farthest) <= bound) & (only != own[i]))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; one beyond the largest double is infinite."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        step = rows - query
        squares = (step**2).sum(axis=1)
        out = np.sqrt(squares)
        for i in np.flatnonzero(~((squares >= LEAST_SQUARE) & (squares <= MOST_SQUARE))).tolist():
            top = np.abs(step[i]).max()
            if top == 0 or np.isinf(top):
                out[i] = top
            else:
                power = int(np.frexp(top)[1])
                near = np.ldexp(np.ldexp(step[i], -(power // 2)), power // 2 - power)
                out[i] = np.ldexp(np.ldexp(np.sqrt((near**2).sum()), power // 2), power - power // 2)
    return out


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, rows = matrix(left.column("vec")), matrix(right.column("vec"))
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(rows):
            own, ids = left.column("query_id").to_numpy(), right.column("ids").to_pylist()
            several = np.iinfo(np.int64).min
            only = np.array([i[0] if len(i) == 1 else several for i in ids])
            for i, near in tile(queries, rows, own, only, k):
                exact = distances(rows[near], queries[i])
                hits = ((d, v) for d, r in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[r] if v != own[i])
                out += [(int(own[i]), v, d) for d, v in heapq.nsmallest(k, hits)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    return search


def _merge(k: int):
    def merge(group: pa.Table) -> pa.Table:
        """Heaps of the k nearest per query over all tiles of some queries."""
        heaps: dict[int, list[tuple[float, int]]] = {}
        for q, v, d in zip(*(group.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
            heap = heaps.setdefault(q, [])
            if len(heap) < k:
                heapq.heappush(heap, (-d, -v))
            elif (-d, -v) > heap[0]:
                heapq.heapreplace(heap, (-d, -v))
        out = [(q, rank, -v, -d) for q, heap in heaps.items() for rank, (d, v) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return merge


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other vectors of each query by Euclidean distance, exactly.

    Ties go to the smaller id; distances beyond the largest double are infinite, and tie. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor do rows with a null id; vectors
    meet only those of their own length. Each row is a candidate, rows that
    repeat too, but no row of the query's id answers it; equal queries are
    answered once. Fewer than ``k`` others: all of them.
    Extra columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), is_query.alias("_asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & is_valid(F.col("embedding")))
    rows = rows.withColumn("vec", doubles(F.col("embedding"))).drop("embedding")
    # Equal vectors become one row with the k + 1 smallest ids. Spark cuts each map task's share to as many before the shuffle.
    least = rows.withColumn("_turn", F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))).filter(F.col("_turn") <= k + 1)
    points = settle(least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "near-points")
    asks = rows.filter("_asks").select(F.col("vec_id").alias("query_id"), "vec")
    asks = settle(asks.distinct(), "near-queries")
    n_left, n_right = -(-asks.count() // tile_rows), -(-points.count() // tile_rows)

    def blocks(df: DataFrame, n: int, key: str) -> DataFrame:
        return df.withColumn(key, F.pmod(F.xxhash64("vec", *[c for c in df.columns if c == "query_id"]), F.lit(max(n, 1))))

    def other(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).cast("array<bigint>"))

    left = blocks(asks, n_left, "_i").withColumn("_j", other(n_right)).withColumn("_dim", F.size("vec"))
    right = blocks(points, n_right, "_j").withColumn("_i", other(n_left)).withColumn("_dim", F.size("vec"))
    keys = ["_dim", "_i", "_j"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), HITS)
    # Queries are merged in bunches, each of at most a few thousand times the number of tiles.
    bunches = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_left)
    bunched = hits.withColumn("_bunch", F.pmod(F.xxhash64("query_id"), F.lit(bunches)))
    return bunched.groupBy("_bunch").applyInArrow(lambda g: _merge(k)(g), "query_id long, rank int, vec_id long, score double")


@query()
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
