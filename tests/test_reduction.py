"""Wide principal components against a full decomposition and today's operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codepairs.operators.reduction import lead_directions, pca_reduce_wide, principal_axes
from codepairs.operators.vectors import pca_reduce


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(parts)


def full(x, k):
    centred = x - x.mean(axis=0)
    _, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:k].T
    signs = np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] >= 0, 1.0, -1.0)
    return centred @ (axes * signs), sizes[:k] / np.sqrt(len(x) - 1)


@pytest.mark.parametrize("n, dim, k", [(300, 100, 3), (40, 200, 2), (200, 7, 7)])
def test_equals_full_decomposition(spark, n, dim, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim)) * np.linspace(5, 1, dim) + rng.normal(size=dim) * 100
    rows = pca_reduce_wide(frame(spark, x), "vec", k).orderBy("id").collect()
    want, deviations = full(x, k)
    assert np.abs(np.array([[r[f"pc{i}"] for i in range(k)] for r in rows]) - want).max() < 1e-6
    assert np.allclose(principal_axes(frame(spark, x), "vec", k)[2], deviations)


def test_equals_the_other_operator_at_64_dimensions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    a = {r.vec_id: (r.pc0, r.pc1) for r in pca_reduce_wide(rows, "embedding", 2).collect()}
    b = {r.vec_id: (r.pc0, r.pc1) for r in pca_reduce(rows, "embedding", 2).collect()}
    assert a.keys() == b.keys() and max(abs(x - y) for i in a for x, y in zip(a[i], b[i], strict=True)) < 1e-6


@pytest.mark.parametrize("n, dim", [(4000, 64), (1500, 150)])
def test_axes_of_much_alike_strength_are_found(n, dim):
    x = np.random.default_rng(dim).normal(size=(n, dim))
    x -= x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    found = lead_directions(lambda block: x.T @ (x @ block), dim, 2, 26, 42, 60)
    # The axes lie in what the directions span.
    assert np.abs(axes[:2].T - found @ (found.T @ axes[:2].T)).max() < 1e-9


def test_rows_agree_to_rounding_with_the_other_operator(spark):
    rows = frame(spark, np.random.default_rng(5).normal(size=(3000, 64)))
    a, b = (f(rows, "vec", 2).orderBy("id").select("pc0", "pc1").toPandas().to_numpy() for f in (pca_reduce_wide, pca_reduce))
    assert np.abs(a - b).max() < 1e-10


def test_20000_dimensions(spark):
    """A square matrix of that size would take 3.2 GB."""
    signal = spark.range(60).repartition(6)
    wave = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda j: F.cos(j * 0.01) * (F.col("id") % 7) + F.sin(j * 0.003) * (F.col("id") % 5) * 3)
    got = pca_reduce_wide(signal.select("id", wave.alias("vec")), "vec", 2, spare=6).orderBy("id").collect()
    j, i = np.arange(20_000), np.arange(60)[:, None]
    want, _ = full(np.cos(j * 0.01) * (i % 7) + np.sin(j * 0.003) * (i % 5) * 3, 2)
    assert np.abs(np.array([[r.pc0, r.pc1] for r in got]) - want).max() < 1e-6


def test_odd_input(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0])], "id long, vec array<float>")
    got = {r.id: (r.pc0, r.pc1) for r in pca_reduce_wide(df, "vec", 2).collect()}
    assert got[2] == (None, None) and np.allclose([got[1], got[3]], 0)
    with pytest.raises(ValueError, match="no vectors"):
        pca_reduce_wide(df.filter("id = 2"), "vec")
    with pytest.raises(ValueError, match="length"):
        pca_reduce_wide(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>"), "vec", 1)
    with pytest.raises(ValueError, match="components"):
        pca_reduce_wide(df, "vec", 3)
