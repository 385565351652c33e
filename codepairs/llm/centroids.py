"""Centroid clustering by equal-average equal-variance search, in whole numbers.

Components are scaled and floored, so every sum and distance is exact. Centroids
are sorted by the sum of their components. A vector starts at the centroid whose
sum is nearest to its own and scans outward; with ``d`` components, sums ``S``
and deviations ``V`` (``V² = d Σx² - S²``),

    d |x - c|² >= (S_x - S_c)² + (V_x - V_c)²

so the scan ends where the first square alone exceeds what was found (the mean
inequality), and a centroid is passed over where both do (the deviation
inequality). What is left is measured in whole numbers. Both sides of a
comparison keep ties, so the smaller number wins as in a full search.

A batch of vectors scans in step. Sums per centroid leave a task as digits to
the base 2^32, which add up natively and without overflow; a round sends the
centroids, whose number and length are parameters, and nothing else to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.llm.registry import query, table
from codepairs.session import bounded_broadcast, settle

# Vectors that scan in step.
SLICE = 4096
DIGIT = 32

Centroids = list[list[int]]


def whole(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of the rows of a list column as doubles, which hold it exactly where the second array, one flag a row, says so."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        values = np.floor(values * scale)
    # Below this bound d times a squared distance fits 62 bits.
    return values, (np.abs(values) < 2**30 // max(dim, 1)).all(axis=1)


def whole_row(row: np.ndarray, scale: int) -> list[int]:
    """The same for one row of any size, as Python's whole numbers."""
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in row.tolist()]


@dataclass
class Search:
    """Centroids in the order of their sums, with what bounds a distance to them."""

    centroids: Centroids

    def __post_init__(self) -> None:
        self.dim = len(self.centroids[0])
        self.narrow = all(abs(x) < 2**30 // max(self.dim, 1) for c in self.centroids for x in c)
        if self.narrow:
            rows = np.array(self.centroids, dtype=np.int64).reshape(len(self.centroids), self.dim)
            self.order = np.lexsort((np.arange(len(rows)), rows.sum(axis=1)))
            self.rows = rows[self.order]
            self.sums, self.spread = self.bounds(self.rows)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = rows.sum(axis=1)
        return sums, np.sqrt((self.dim * (rows * rows).sum(axis=1) - sums * sums).astype(np.float64))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For rows of 64-bit whole numbers: the nearest centroid, the squared distance, and how many distances were computed in all."""
        n, k = len(rows), len(self.rows)
        sums, spread = self.bounds(rows)
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        up = np.searchsorted(self.sums, sums)
        down, live, computed = up - 1, np.arange(n), 0
        far = np.iinfo(np.int64).max
        while len(live):
            above = np.where(up[live] < k, np.abs(self.sums[np.minimum(up[live], k - 1)] - sums[live]), far)
            below = np.where(down[live] >= 0, np.abs(sums[live] - self.sums[np.maximum(down[live], 0)]), far)
            gap = np.minimum(above, below)
            # Nearest sums first, so the scan of a vector ends at the first sum that is too far.
            limit = np.where(best[live] == far, np.inf, self.dim * best[live].astype(np.float64))
            go = (gap < far) & (gap.astype(np.float64) ** 2 <= limit * (1 + 1e-12))
            live, gap, limit, rise = live[go], gap[go], limit[go], (above <= below)[go]
            at = np.where(rise, up[live], down[live])
            up[live[rise]] += 1
            down[live[~rise]] -= 1
            apart = np.maximum(np.abs(spread[live] - self.spread[at]) - 1e-6, 0.0)
            near = gap.astype(np.float64) ** 2 + apart**2 * (1 - 1e-9) <= limit * (1 + 1e-12)
            rest, at = live[near], at[near]
            step = rows[rest] - self.rows[at]
            distance = (step * step).sum(axis=1)
            computed += len(rest)
            number = self.order[at]
            better = (distance < best[rest]) | ((distance == best[rest]) & (number < found[rest]))
            best[rest[better]], found[rest[better]] = distance[better], number[better]
        return found, best, computed

    def nearest_of(self, row: list[int]) -> tuple[int, int]:
        """For one row of any size, by a full search."""
        squares = ((sum((x - y) ** 2 for x, y in zip(row, c, strict=True)), i) for i, c in enumerate(self.centroids))
        distance, number = min(squares)
        return number, distance


def _batches(batches: Iterator[pa.RecordBatch], search: Search, scale: int):
    """Slices of the batches with their whole numbers: doubles, exact rows, cluster and distance of each, and the others' rows."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            vectors = part.column("vec")
            rows, exact = whole(vectors, search.dim, scale)
            exact &= search.narrow
            cluster, distance = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=object)
            fast = np.flatnonzero(exact)
            cluster[fast], distance[fast], _ = search.nearest(rows[fast].astype(np.int64)) if len(fast) else (0, 0, 0)
            wide = {}
            for i in np.flatnonzero(~exact).tolist():
                wide[i] = whole_row(np.array(vectors[i].as_py(), dtype=np.float64), scale)
                cluster[i], distance[i] = search.nearest_of(wide[i])
            yield part, rows, fast, wide, cluster, distance


def _sums(search: Search, scale: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and centroid the number of its vectors and their sums, as digits."""
        k = len(search.centroids)
        totals = [[0] * search.dim for _ in range(k)]
        counts = [0] * k
        for _, rows, fast, wide, cluster, _ in _batches(batches, search, scale):
            for c in np.unique(cluster).tolist():
                own = fast[cluster[fast] == c]
                added = rows[own].astype(np.int64).sum(axis=0).tolist()
                totals[c] = [a + b for a, b in zip(totals[c], added, strict=True)]
                counts[c] += int((cluster == c).sum())
            for i, row in wide.items():
                totals[cluster[i]] = [a + b for a, b in zip(totals[cluster[i]], row, strict=True)]
        out = [(c, -1, 0, counts[c]) for c in range(k) if counts[c]]
        for c in range(k):
            for j, total in enumerate(totals[c]):
                sign, total, place = (-1 if total < 0 else 1), abs(total), 0
                while total:
                    out.append((c, j, place, sign * (total & (1 << DIGIT) - 1)))
                    total, place = total >> DIGIT, place + 1
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "component", "place", "digit"])

    return sums


def _told(search: Search, scale: int):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, _, cluster, distance in _batches(batches, search, scale):
            known = [int(d) if d < 2**63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(known, pa.int64())], names=["vec_id", "cluster", "distance"])

    return told


def kept_vectors(vectors: DataFrame, components: int) -> DataFrame:
    """``vec_id, vec`` of the rows whose vector has so many components, none null or non-finite; stored."""
    vec = F.col("embedding")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.coalesce((F.size(vec) == components) & ~bad, F.lit(False))
    return settle(vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")), "centroid-vectors")


def first_centroids(kept: DataFrame, clusters: int, scale: int, salt: str) -> Centroids:
    """The vectors with the smallest digests of ``salt`` and id, in that order; equal ids are ordered by their vectors. Rows without an id are none."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    start = kept.filter("vec_id is not null").select("vec", digest.alias("_digest")).orderBy("_digest", "vec").limit(clusters)
    return [whole_row(np.array(r["vec"], dtype=np.float64), scale) for r in start.collect()]


def refine(kept: DataFrame, centroids: Centroids, scale: int) -> Centroids:
    """One round: every vector to its nearest centroid, every centroid that has any to the floor of their mean."""
    sums = kept.mapInArrow(_sums(Search(centroids), scale), "cluster int, component int, place int, digit long")
    # A row per centroid, component and digit, however many vectors there are.
    found = sums.groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit")).collect()
    counts = {r["cluster"]: r["digit"] for r in found if r["component"] < 0}
    totals = {c: [0] * len(centroids[0]) for c in counts}
    for r in found:
        if r["component"] >= 0:
            totals[r["cluster"]][r["component"]] += r["digit"] << (DIGIT * r["place"])
    return [[t // counts[c] for t in totals[c]] if c in counts else old for c, old in enumerate(centroids)]


def cluster_vectors(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, salt: str = "1:"
) -> tuple[DataFrame, Centroids]:
    """``vec_id, cluster, distance`` of every kept vector, stored, and the final centroids.

    Kept are vectors (``embedding``) of exactly ``components`` components, none null or
    non-finite; zero vectors are vectors like others. A row with a null id is
    assigned, but is no start. With fewer kept vectors than ``clusters`` there
    are as many centroids as vectors. Rows that repeat count each. Components
    of any finite size are exact; a squared distance that does not fit a long is
    null. Extra columns are ignored; no kept vectors give no rows and no centroids.
    """
    kept = kept_vectors(vectors, components)
    centroids = first_centroids(kept, clusters, scale, salt)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = refine(kept, centroids, scale)
    return settle(kept.mapInArrow(_told(Search(centroids), scale), schema), "centroid-clusters"), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(told: DataFrame, centroids: Centroids) -> DataFrame:
    """``told`` with the sums of the distances of its cluster and of all, null where one does not fit a long, and the centroid's digest."""
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    # A row per centroid.
    sums = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in told.groupBy("cluster").agg(total.alias("total")).collect()}
    every = None if None in sums.values() else sum(sums.values())

    def fit(x: int | None) -> int | None:
        return None if x is None or x >= 2**63 else x

    rows = [(c, fit(x), fit(every), centroid_digest(centroids[c])) for c, x in sums.items()]
    each = told.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(bounded_broadcast(each, len(centroids)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
a{i} AS MATERIALIZED (SELECT v.vec_id, arg_min(c.c, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.c)) AS c FROM v, c{i} c GROUP BY v.vec_id),
s{i} AS (SELECT a.c, j, sum(v.q[j]) AS s, count(*) AS n FROM a{i} a JOIN v USING (vec_id), generate_series(1, 64) g(j) GROUP BY a.c, j),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{i} GROUP BY c),
c{n} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN m{i} m USING (c)),"""

SQL = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),"""
    + "".join(_ROUND.format(i=i, n=i + 1) for i in range(3))
    + """
d AS MATERIALIZED (SELECT v.vec_id, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c3 c),
t AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d GROUP BY vec_id)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM t JOIN c3 USING (c)"""
)


@query(SQL)
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centroids after three rounds, and every vector's place."""
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))
