import numpy as np
import pytest
from pyspark.sql import functions as F

from codepairs.catalog import QUERIES
from codepairs.operators import vectors


def tokens(seed, n, dim=5):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def expected(m):
    wide = m.astype(np.float64)
    inner = wide[1:-1]
    return wide[0], (inner.max(axis=0) if len(inner) else None), (inner.mean(axis=0) if len(inner) else None)


def check(row, m):
    for got, want in zip((row["cls"], row["max"], row["mean"]), expected(m), strict=True):
        assert (got is None) == (want is None)
        if want is not None:
            np.testing.assert_allclose(got, want, rtol=1e-12)


SIZES = {"none": 1, "two": 2, "three": 3, "four": 4, "some": 17, "hot": 400}


@pytest.mark.parametrize("run", [1, 2, 4, 16, 4096])
def test_pool_vectors_by_token(spark, run):
    docs = {k: tokens(i, n) for i, (k, n) in enumerate(SIZES.items())}
    rows = [(k, p, [float(x) for x in v]) for k, m in docs.items() for p, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id string, pos int, vec array<float>").repartition(5)
    got = {r["id"]: r for r in vectors.pool_vectors(df, "id", "pos", "vec", run).collect()}
    assert set(got) == set(docs)
    for k, m in docs.items():
        check(got[k], m)


def test_pool_matrix_in_one_row(spark):
    docs = {k: tokens(i, n) for i, (k, n) in enumerate(SIZES.items())}
    df = spark.createDataFrame([(k, m.tolist()) for k, m in docs.items()], "id string, m array<array<float>>")
    pooled = vectors.pool_matrix(F.col("m"))
    for r in df.select("id", *[c.alias(n) for n, c in pooled.items()]).collect():
        check(r, docs[r["id"]])


def test_pool_concat(spark):
    df = spark.createDataFrame([([1.0], [2.0], [3.0])], "cls array<double>, max array<double>, mean array<double>")
    assert df.select(vectors.pool_concat(["mean", "cls"]).alias("v")).first().v == [1.0, 3.0]
    assert df.select(vectors.pool_concat(["mean", "max", "cls"]).alias("v")).first().v == [1.0, 2.0, 3.0]
    for bad in ([], ["sum"]):
        with pytest.raises(ValueError):
            vectors.pool_concat(bad)


def test_pool_concat_keeps_the_place_of_a_missing_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0], None), (None, None)], "cls array<double>, mean array<double>")
    assert [r.v for r in df.select(vectors.pool_concat(["mean", "cls"]).alias("v")).collect()] == [[1.0, 2.0, None, None], None]


def test_pooled_queries_keep_documents_of_one_and_two_tokens(spark, tmp_path):
    rows = [(i, [i / 8, -i / 8]) for i in (0, 1, 2, 3, 4, 5, 10, 11)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r) for r in QUERIES["pool_vectors"](spark, str(tmp_path)).collect()}
    assert {r for r in got if r[0]} == {(1, 0, 0.625, None, None), (1, 1, -0.625, None, None), (2, 0, 1.25, None, None), (2, 1, -1.25, None, None)}
    assert {r for r in got if not r[0]} == {(0, 0, 0.0, 0.375, 0.25), (0, 1, 0.0, -0.125, -0.25)}
    joined = {tuple(r) for r in QUERIES["pool_concat"](spark, str(tmp_path)).collect()}
    assert joined == {(d, i, c) for d, i, c, _, _ in got} | {(d, i + 2, m) for d, i, _, _, m in got}


def test_cosine(spark):
    a, b = tokens(1, 20), tokens(2, 20)
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(20)] + [(20, [0.0] * 5, b[0].tolist()), (21, [0.0] * 5, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    got = [r.inspect_cls for r in vectors.cosine_pairwise(df, {"cls": ("a", "b")}).orderBy("id").collect()]
    x, y = a.astype(np.float64), b.astype(np.float64)
    np.testing.assert_allclose(got[:20], (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1), rtol=1e-12)
    assert got[20:] == [0.0, 0.0]


@pytest.mark.parametrize("k", [2, 3])
def test_pca_matches_a_decomposition(spark, k):
    m = tokens(3, 60) * np.array([5, 3, 2, 1, 0.5]) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, vec array<float>")
    rows = vectors.pca_reduce(df, "vec", k).orderBy("id").collect()
    got = np.array([[r[f"pc{i}"] for i in range(k)] for r in rows])
    centred = m.astype(np.float32).astype(np.float64)
    centred -= centred.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:k]
    axes *= np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    np.testing.assert_allclose(got, centred @ axes.T, atol=1e-9)


def test_embedding_table(spark):
    coords = spark.createDataFrame([(1, "c", 0.5, 1.5)], "id int, code string, pc0 double, pc1 double")
    clusters = spark.createDataFrame([(1, True, -1)], "id int, is_core boolean, cluster int")
    assert vectors.embedding_table(coords, None, "id", ["code"]).columns == ["id", "code", "pc0", "pc1"]
    assert vectors.embedding_table(coords, clusters, "id", ["code"]).first().label_type == "noise"
