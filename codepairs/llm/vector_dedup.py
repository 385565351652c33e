"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one vector kept per group.

Centres are fitted on a bounded sample; every vector is assigned. Each vector
lives in the cell of its nearest centre and visits those cells of higher number
whose dividing plane is within reach, so a linked pair that a plane parts still
meets once. Cells are cut into blocks of bounded size, and blocks of those that
live in a cell are multiplied with one another and with blocks of its visitors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.llm.components import components, spanning
from codepairs.llm.registry import query, table
from codepairs.llm.vectors import doubles, is_valid, matrix
from codepairs.session import settle

COSINE = 0.95
# Vectors per cell of the sample that centres are fitted on, passes over it, rows of a block, and of what is multiplied at once.
SAMPLE_PER_CELL = 16
PASSES = 6
BLOCK_ROWS = 4096
STRIP = 512
# Standard deviations of the step to a linked vector, across a plane, that a visit allows for: any step.
DEVIATIONS = math.inf
# Below this distance of two centres the place of their plane is lost in rounding.
LEAST_APART = 1e-4


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first to a range in which squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, passes: int = PASSES) -> np.ndarray:
    """Unit centres; the first ``cells`` rows of the sample are the start, and an empty cell keeps its centre."""
    centres = sample[:cells].copy()
    for _ in range(passes):
        home = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centres


def _assign(shared, reach: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        # A sphere seen in high dimensions: distances between centres by their products.
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                products = units(matrix(part.column("vec"))) @ centres.T
                home = products.argmax(axis=1)
                ahead = (products[np.arange(len(home)), home][:, None] - products) / apart[home]
                visits = ((ahead <= reach) | (apart[home] < LEAST_APART)) & (np.arange(len(centres))[None, :] > home[:, None])
                row, cell = np.nonzero(visits)
                rows = np.concatenate([np.arange(len(home)), row])
                cells = np.concatenate([home, cell])
                own = pa.array(np.arange(len(rows)) < len(home))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.astype(np.int64)), own], [*part.schema.names, "cell", "resident"])

    return assign


def _compare(cosine: float):
    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between two blocks of a cell, as counts per vector and the edges of a spanning forest."""
        out: dict[str, list[np.ndarray]] = {"p": [], "links": [], "root": []}
        if len(left) and len(right):
            same = key[1].as_py() == key[2].as_py()
            a, b = units(matrix(left.column("vec"))), units(matrix(right.column("vec")))
            near = np.concatenate([a[i : i + STRIP] @ b.T >= cosine for i in range(0, len(a), STRIP)])
            if same:
                np.fill_diagonal(near, False)
            p_a, p_b = (t.column("p").to_numpy() for t in (left, right))
            w_a, w_b = (t.column("weight").to_numpy() for t in (left, right))
            links_a = np.concatenate([near[i : i + STRIP] @ w_b for i in range(0, len(a), STRIP)])
            links_b = sum(w_a[i : i + STRIP] @ near[i : i + STRIP] for i in range(0, len(a), STRIP))
            sides = [(p_a, links_a)] if same else [(p_a, links_a), (p_b, links_b)]
            for p, links in sides:
                out["p"].append(p[links > 0])
                out["links"].append(links[links > 0])
                out["root"].append(p[links > 0])
            if same:
                node, root = spanning(near)
                p_all = p_a
            else:
                linked = (np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0)))
                n = len(linked[0])
                square = np.zeros((n + len(linked[1]),) * 2, dtype=bool)
                square[:n, n:] = near[np.ix_(*linked)]
                square[n:, :n] = square[:n, n:].T
                node, root = spanning(square)
                p_all = np.concatenate([p_a[linked[0]], p_b[linked[1]]])
            out["p"].append(p_all[node])
            out["links"].append(np.zeros(len(node), dtype=np.int64))
            out["root"].append(p_all[root])
        arrays = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()) for v in out.values()]
        return pa.table(arrays, names=list(out))

    return compare


def near_vectors(vectors: DataFrame, cosine: float = COSINE, deviations: float = DEVIATIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links of cosine ``>= cosine``, in double precision.

    No link is reported below the threshold, and none is missed: every step across
    a plane that is possible is allowed for. Only with a finite ``deviations`` one
    can be missed between two cells, if its step across their plane is longer than
    so many standard deviations of a step of that length in a random direction.

    Equal vectors are folded before and counted after. A vector that is null,
    empty, zero or holds a null or non-finite component links with nothing, as
    does a row with a null id (component null, kept); vectors of different
    length do not link. Rows that share an id are rows of their own, in one
    component if any of them links. Extra columns are ignored; an empty table gives an empty one.
    """
    good = F.col("vec_id").isNotNull() & is_valid(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, doubles(F.col("embedding"))).alias("vec"))
    folded = rows.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    points = settle(folded.withColumn("p", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vec-points")
    found = None
    # Lengths of vectors differ only if tables were mixed; each has its own cells.
    for dim, n in sorted((r["dim"], r["count"]) for r in points.groupBy("dim").count().collect()):
        links = _links(points.filter(F.col("dim") == dim), dim, n, cosine, deviations, block_rows)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = settle(found, "vec-links")
    edges = found.filter("p <> root").select(F.col("p").alias("u"), F.col("root").alias("v"))
    joined = components(edges)
    degrees = found.groupBy("p").agg(F.sum("links").alias("links"))
    named = points.select("p", "vec", "id", "weight").join(degrees, "p", "left").join(joined, F.col("p") == F.col("node"), "left")
    named = named.withColumn("_group", F.coalesce("component", "p"))
    named = settle(named.select("vec", "id", "_group", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links")), "vec-named")
    least = settle(named.groupBy("_group").agg(F.min("id").alias("_least")), "vec-least")
    named = settle(named.join(least, "_group").select(F.col("vec").alias("_vec"), "_links", "_least"), "vec-named")
    told = rows.join(named, F.col("vec") == F.col("_vec"), "left")
    component = F.coalesce("_least", "vec_id")
    return told.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _links(points: DataFrame, dim: int, n: int, cosine: float, deviations: float, block_rows: int) -> DataFrame:
    spark = points.sparkSession
    # No smaller than a block: where next to no plane is out of reach, a vector visits about half of them.
    cells = max(1, min(math.isqrt(n), math.ceil(n / block_rows)))
    sample = points.orderBy(F.xxhash64("vec")).limit(cells * SAMPLE_PER_CELL).select("vec").toArrow()
    centres = spherical_kmeans(units(matrix(sample.column("vec"))), cells)
    step = math.sqrt(2 - 2 * cosine)
    # The planes go through the origin, so what lies beyond one is as far as the sine of the angle at least.
    farthest = math.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0
    reach = min(farthest, deviations * step / math.sqrt(dim) if step > 0 else 0.0) + 1e-6
    kept = points.select("p", "vec", "weight")
    placed = kept.mapInArrow(_assign(spark.sparkContext.broadcast(centres), reach), "p long, vec array<double>, weight long, cell long, resident boolean")
    placed = settle(placed, "vec-cells")
    sizes = placed.groupBy("cell").agg(*[F.ceil(F.count(F.when(own, 1)) / block_rows).alias(c) for c, own in (("own", F.col("resident")), ("guests", ~F.col("resident")))])
    placed = placed.join(F.broadcast(sizes), "cell")  # one row per cell, of which there are as many as the root of the rows at most
    share = F.pmod(F.xxhash64("p"), F.when(F.col("resident"), F.col("own")).otherwise(F.col("guests")))
    placed = placed.withColumn("block", F.when(F.col("resident"), share).otherwise(F.col("own") + share))
    # Of a pair of blocks (block, other) of a cell the first is of residents; blocks of visitors have the higher numbers.
    left = placed.filter("resident").withColumn("other", F.explode(F.sequence(F.col("block"), F.col("own") + F.col("guests") - 1)))
    last = F.least(F.col("other"), F.col("own") - 1)
    right = placed.filter("own > 0").withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    keys = ["cell", "block", "other"]
    left = left.select(*keys, "p", "vec", "weight")
    right = right.select(*[F.col(c).alias(c) for c in (*keys, "p", "vec", "weight")])  # columns of their own
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(cosine), "p long, links long, root long")


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, w) AS (SELECT u, w FROM near UNION SELECT r.u, n.w FROM reach r JOIN near n ON r.w = n.u),
least AS (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS n FROM near GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN links l ON vec_id = l.u LEFT JOIN least m ON vec_id = m.u"""


@query(SQL)
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
