"""Density clustering at a fixed cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.operators.blocks import Block, block_pairs, in_cells, per_block, rows_per_block
from codepairs.operators.components import connected_components
from codepairs.operators.records import union_sets
from codepairs.session import bounded_broadcast, settle


def _degrees(threshold: float):
    def count(group: pa.Table) -> pa.Table:
        block = Block(group, "_vec")
        sides = [block.left] if block.same else [block.left, block.right]
        weights = [side.column("_weight").to_numpy().astype(np.float64) for side in sides]
        near = [np.zeros(len(w)) for w in weights]  # whole numbers
        for i, j, s in block.tiles():
            row, col = np.divmod(np.flatnonzero(s >= threshold), s.shape[1])
            if block.same and i == j:
                row, col = row[row != col], col[row != col]
            near[0][i : i + len(s)] += np.bincount(row, weights=weights[-1][col + j], minlength=len(s))
            if not block.same or i < j:
                near[-1][j : j + s.shape[1]] += np.bincount(col, weights=weights[0][row + i], minlength=s.shape[1])
        parts = [
            pa.table([side.column("_id").filter(pa.array(w > 0)), pa.array(w[w > 0].astype(np.int64))], names=["_id", "_near"])
            for side, w in zip(sides, near, strict=True)
        ]
        return pa.concat_tables(parts)

    return count


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a two-sided block graph: one edge per node that is first reached."""
    rows, cols = near.shape
    seen_row, seen_col = np.zeros(rows, dtype=bool), np.zeros(cols, dtype=bool)
    from_, to = [], []
    for start in range(rows):
        if seen_row[start]:
            continue
        seen_row[start] = True
        frontier = [start]
        while frontier:
            row = frontier.pop()
            fresh = np.flatnonzero(near[row] & ~seen_col)
            seen_col[fresh] = True
            from_.extend([row] * len(fresh))
            to.extend(fresh)
            for col in fresh:
                next_rows = np.flatnonzero(near[:, col] & ~seen_row)
                seen_row[next_rows] = True
                from_.extend(next_rows)
                to.extend([col] * len(next_rows))
                frontier.extend(next_rows)
    return np.array(from_, dtype=np.int64), np.array(to, dtype=np.int64)


class Forest:
    """A spanning forest of links that arrive in bunches: a link is kept if its ends were not yet joined."""

    def __init__(self, nodes: int):
        self.tree = np.arange(nodes)
        self.from_: list[np.ndarray] = []
        self.to: list[np.ndarray] = []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            apart = self.tree[u] != self.tree[v]
            u, v = u[apart], v[apart]
            if not len(u):
                return
            low, high = np.minimum(self.tree[u], self.tree[v]), np.maximum(self.tree[u], self.tree[v])
            # Every tree takes one link to a lower one.
            trees, first = np.unique(high, return_index=True)
            self.from_.append(u[first])
            self.to.append(v[first])
            root = np.arange(len(self.tree))
            root[trees] = low[first]
            while (root[root] != root).any():
                root = root[root]
            self.tree = root[self.tree]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(none + self.from_), np.concatenate(none + self.to)


def _links(threshold: float):
    """Core-core links thinned to a spanning forest per block pair; every link of a core with a point that is not."""

    def link(group: pa.Table) -> pa.Table:
        block = Block(group, "_vec")
        # Rows of both sides are numbered through.
        rows = block.left if block.same else pa.concat_tables([block.left, block.right])
        start = 0 if block.same else block.left.num_rows
        ids, core = rows.column("_id"), rows.column("_core").to_numpy(zero_copy_only=False).astype(bool)
        forest, outer, inner = Forest(len(core)), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, j, s in block.tiles():
            row, col = np.divmod(np.flatnonzero(s >= threshold), s.shape[1])
            u, v = row + i, col + j + start
            both = core[u] & core[v]
            forest.add(u[both], v[both])
            one = core[u] != core[v]
            if block.same and i == j:
                one &= u < v
            u, v = u[one], v[one]
            outer.append(np.where(core[u], v, u))
            inner.append(np.where(core[u], u, v))
        tables = [(*forest.links(), True), (np.concatenate(outer), np.concatenate(inner), False)]
        return pa.concat_tables(
            [pa.table([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(np.full(len(u), kind))], names=["u", "v", "core"]) for u, v, kind in tables]
        )

    return link


def dense_rank_ids(df: DataFrame, col: str) -> DataFrame:
    """``(col, cluster)``: distinct values numbered from 0 in order, without a single-task sort.

    The values are range-partitioned and stored with their partition number; the
    starts of the partitions are a table of one row per partition.
    """
    ranged = df.select(col).distinct().repartitionByRange(col).withColumn("_part", F.spark_partition_id())
    stored = settle(ranged, "ranks")
    n_parts = stored.sparkSession.conf.get("spark.sql.shuffle.partitions")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = stored.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(col))
    return stored.join(bounded_broadcast(starts.select("_part", "_start"), int(n_parts)), "_part").select(
        col, (F.col("_start") + rank - 1).cast("int").alias("cluster")
    )


def density_cluster(
    df: DataFrame, id_col: str, vec_col: str, threshold: float, min_pts: int, block_rows: int | None = None
) -> DataFrame:
    """``(id, is_core, cluster)``: fixed-radius density clustering, -1 for noise.

    A point is a core if at least ``min_pts`` points, itself included, have a
    cosine of ``threshold`` or more with it. Linked cores share a cluster; another
    point joins the lowest cluster among its cores. Clusters are numbered by
    their smallest core.

    Copies of a vector are folded into one weighted point first, and dense balls
    of near copies are linked through their pivot. Blocks then return degrees, a spanning forest of the cores, and the fewer than
    ``min_pts`` links that a point which is no core can have, so the number of
    links stays linear however dense the data is. A zero vector has cosine 0 with
    everything and is noise.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    digest = F.md5(F.col(vec_col).cast("string"))
    norm = F.aggregate(vec_col, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    source = df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"), digest.alias("_digest"), (norm > 0).alias("_real"))
    points = settle(
        source.filter("_real").groupBy("_digest").agg(
            F.min("_id").alias("_id"), F.min_by("_vec", "_id").alias("_vec"), F.count("*").alias("_weight")
        ),
        "points",
    )
    id_type = df.schema[id_col].dataType.simpleString()

    n_points, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("_vec")), F.lit(0))).first()
    block_rows = block_rows or rows_per_block(n_points, width)
    celled, cells = in_cells(points, "_id", "_vec", n_points, threshold, block_rows, "_weight", min_pts)
    partial = per_block(
        block_pairs(celled.drop("_digest"), "_id", n_points, block_rows), _degrees(threshold), f"_id {id_type}, _near bigint"
    )
    near = partial.groupBy("_id").agg(F.sum("_near").alias("_near"))
    is_core = F.col("_ball").isNotNull() | ((F.col("_weight") + F.coalesce("_near", F.lit(0))) >= min_pts)
    marked = settle(celled.join(near, "_id", "left").withColumn("_core", is_core).drop("_weight", "_near"), "cores")

    links = per_block(
        block_pairs(marked.drop("_digest"), "_id", n_points, block_rows), _links(threshold), f"u {id_type}, v {id_type}, core boolean"
    )
    if cells is not None and cells.dense.any():
        balls = marked.filter("_ball IS NOT NULL").select(F.col("_id").alias("u"), F.col("_ball").alias("v"), F.lit(True).alias("core"))
        # A forest over the pivots, so fewer edges than there are pivots.
        i, j = _forest(cells.close())
        bridges = [(cells.ids[a], cells.ids[b], True) for a, b in zip(i, j, strict=True)]
        links = union_sets(links, balls, df.sparkSession.createDataFrame(bridges, links.schema))
    links = settle(links, "links")
    own = marked.filter("_core").select(F.col("_id").alias("u"), F.col("_id").alias("v"))
    roots = settle(connected_components(links.filter("core").select("u", "v").unionByName(own)), "roots")
    border = (
        links.filter("NOT core").join(roots.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("root"))
    )
    assigned = roots.unionByName(border.select(F.col("u").alias("node"), "root"))
    numbered = assigned.join(dense_rank_ids(roots, "root"), "root").select(F.col("node").alias("_id"), "cluster")

    by_digest = marked.join(numbered, "_id", "left").select("_digest", "_core", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return source.drop("_vec").join(by_digest, "_digest", "left").select(
        F.col("_id").alias(id_col), F.coalesce("_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )
