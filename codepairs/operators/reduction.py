"""Principal components of wide vectors, without a matrix of dimension by dimension.

Block Lanczos: a thin random matrix, as wide as the components asked for and some more, is
multiplied by the centred rows and back; what is new in the product is the matrix of the
next pass. The best directions in all of them together are the axes once their
residuals are as small as rounding allows. A pass is one job that returns a thin matrix. After
some passes the best directions stand for all before. At the
end every partition factors its rows' products with the thin basis (QR), the
small triangular factors are merged in a tree, and their singular vectors turn the basis into the axes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepairs.operators.blocks import matrix

SPARE = 24
PASSES = 200
# Matrices held before the best directions replace them.
BLOCKS = 4
# An axis is found when its residual, and so its turn, is this small against the distance to the next one.
STILL = 1e-13
# Below this share of the greatest variance there is rounding only.
ROUNDING = 1e-15
FAN = 16
# Numbers of a slice of rows that is multiplied at once.
CELLS = 1 << 22


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    rows = max(1, CELLS // max(dim, 1))
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield matrix(batch.column("_v").slice(at, rows)).reshape(-1, dim)


def _told(part: int, count: int, value: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([count], pa.int64()), pa.array([value.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "m"])


def _sums(dim: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for rows in _slices(batches, dim):
            total += rows.sum(axis=0)
            n += len(rows)
        yield _told(TaskContext.get().partitionId(), n, total)

    return sums


def _products(shared, dim: int):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The centred rows' transpose times the rows times the basis, summed."""
        mean, basis = shared.value
        total = np.zeros(basis.shape)
        for rows in _slices(batches, dim):
            centred = rows - mean
            total += centred.T @ (centred @ basis)
        yield _told(TaskContext.get().partitionId(), 0, total)

    return products


def _factors(shared, dim: int):
    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The triangular factor of the partition's rows times the basis."""
        mean, basis = shared.value
        held = np.zeros((0, basis.shape[1]))
        for rows in _slices(batches, dim):
            held = np.linalg.qr(np.concatenate([held, (rows - mean) @ basis]), mode="r")
        yield _told(TaskContext.get().partitionId(), 0, held)

    return factors


def _merge(width: int | None):
    """Sums of partial results or, with a width, the triangular factor of stacked ones; in the order of their numbers."""

    def merge(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy(), kind="stable").tolist()
        parts = group.column("m")
        count = int(group.column("n").to_numpy().sum())
        out = None
        for i in order:
            m = parts[i].values.to_numpy()
            if width is None:
                out = m.copy() if out is None else out + m
            else:
                m = m.reshape(-1, width)
                out = m if out is None else np.linalg.qr(np.concatenate([out, m]), mode="r")
        number = int(group.column("part").to_numpy().min()) // FAN
        return pa.Table.from_batches([_told(number, count, out)])

    return merge


def _tree(partials: DataFrame, tasks: int, width: int | None = None) -> tuple[int, np.ndarray]:
    while True:
        partials = partials.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merge(width), "part long, n long, m array<double>")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            row = partials.first()
            return row["n"], np.array(row["m"])


def _fresh(product: np.ndarray, held: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis of what the columns have outside of those held; none where that is rounding."""
    for _ in range(2):
        product = product - held @ (held.T @ product)
    turned, sizes, _ = np.linalg.svd(product, full_matrices=False)
    new = turned[:, sizes > 10 * ROUNDING * scale][:, : held.shape[0] - held.shape[1]]
    return np.linalg.qr(new - held @ (held.T @ new))[0]


def lead_directions(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, width: int, seed: int, passes: int) -> np.ndarray:
    """``width`` directions that hold the ``k`` greatest axes of a symmetric matrix, known by its products ``times``."""
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    held, products = np.zeros((dim, 0)), np.zeros((dim, 0))
    least, stuck = np.inf, 0
    for _ in range(passes):
        held = np.concatenate([held, block], axis=1)
        products = np.concatenate([products, times(block)], axis=1)
        small = held.T @ products
        sizes, turn = np.linalg.eigh((small + small.T) / 2)
        sizes, turn = sizes[::-1], turn[:, ::-1]
        kept = turn[:, :width]
        missed = np.linalg.norm(products @ turn[:, :k] - held @ (turn[:, :k] * sizes[:k]), axis=0)
        gaps = np.array([min(abs(np.delete(sizes, i) - sizes[i]), default=0.0) for i in range(k)])
        block = _fresh(products[:, -block.shape[1] :], held, sizes[0])
        # Equal axes have no distance: there, and where sums round, residuals end by getting no smaller.
        worst = missed.max()
        stuck = stuck + 1 if worst > least / 2 and worst <= 1e-10 * sizes[0] else 0
        least = min(least, worst)
        if (missed <= np.maximum(STILL * gaps, ROUNDING * sizes[0])).all() or stuck == 3 or not block.shape[1]:
            return held @ kept
        if held.shape[1] + block.shape[1] > BLOCKS * width:
            held, products = held @ kept, products @ kept
    raise RuntimeError(f"the axes are not found after {passes} passes")


def principal_axes(df: DataFrame, vec_col: str, k: int = 2, seed: int = 42, spare: int = SPARE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``mean, axes, deviations`` of the vectors: axes as columns, most varied first, each turned so that its loading of greatest magnitude is positive.

    Null vectors are left out; all others must have one length. The driver holds matrices of that length times ``BLOCKS`` times ``k + spare``.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(F.transform(vec_col, lambda x: x.cast("double")).alias("_v"))
    seen = rows.agg(F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high")).first()
    if seen["low"] is None:
        raise ValueError("no vectors")
    if seen["low"] != seen["high"]:
        raise ValueError("vectors differ in length")
    dim = seen["high"]
    if not 0 < k <= dim:
        raise ValueError(f"vectors of {dim} have no {k} components")
    spark, tasks, schema = df.sparkSession, max(1, rows.rdd.getNumPartitions()), "part long, n long, m array<double>"
    n, total = _tree(rows.mapInArrow(_sums(dim), schema), tasks)
    mean = total / n
    width = min(dim, k + spare)

    def times(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((mean, block))
        _, product = _tree(rows.mapInArrow(_products(shared, dim), schema), tasks)
        shared.unpersist()
        return product.reshape(dim, -1)

    basis = np.eye(dim) if width == dim else lead_directions(times, dim, k, width, seed, passes)
    shared = spark.sparkContext.broadcast((mean, basis))
    _, factor = _tree(rows.mapInArrow(_factors(shared, dim), schema), tasks, width)
    _, sizes, turn = np.linalg.svd(factor.reshape(-1, width), full_matrices=False)
    # Fewer rows than components: the others have no variance.
    turn = np.concatenate([turn, np.zeros((max(0, k - len(turn)), width))])
    sizes = np.append(sizes, np.zeros(max(0, k - len(sizes))))
    axes = basis @ turn[:k].T
    signs = np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] >= 0, 1.0, -1.0)
    return mean, axes * signs, sizes[:k] / np.sqrt(max(n - 1, 1))


def pca_reduce_wide(df: DataFrame, vec_col: str, k: int = 2, prefix: str = "pc", seed: int = 42, spare: int = SPARE, passes: int = PASSES) -> DataFrame:
    """Adds the first ``k`` principal coordinates ``pc0, pc1, ...`` of the centred vectors, whatever their length; null vectors have none."""
    mean, axes, _ = principal_axes(df, vec_col, k, seed, spare, passes)
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))

    @F.pandas_udf("array<double>")
    def project(vectors):
        import pandas as pd

        centre, turned = shared.value
        return pd.Series([None if v is None else ((np.asarray(v, dtype=np.float64) - centre) @ turned).tolist() for v in vectors])

    placed = df.withColumn("_pc", project.asNondeterministic()(F.col(vec_col)))
    return placed.withColumns({f"{prefix}{i}": F.col("_pc")[i] for i in range(k)}).drop("_pc")
