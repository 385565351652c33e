"""Vector work: pooling, cosines, and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepairs.functions.text import POOLERS

# Tokens of one document are reduced in runs of this many, so that a document
# of any length is spread over tasks.
TOKEN_RUN = 4096


def _as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _greater(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def _fold(vectors: Column, merge) -> Column:
    """Element-wise fold of an array of vectors; NULL if the array is empty."""
    rest = F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0)))
    return F.when(F.size(vectors) > 0, F.aggregate(rest, F.get(vectors, F.lit(0)), merge))


def pool_matrix(tokens: Column) -> dict[str, Column]:
    """Pooled vectors of a token matrix held in one row, as double arrays.

    ``cls`` is the first row; ``mean`` and ``max`` leave out the first and last
    row and are NULL for fewer than 3 rows.
    """
    wide = F.transform(tokens, _as_double)
    inner = F.slice(wide, 2, F.greatest(F.size(wide) - 2, F.lit(0)))
    total = _fold(inner, _add)
    return {
        "cls": F.get(wide, F.lit(0)),
        "max": _fold(inner, _greater),
        "mean": F.transform(total, lambda x: x / F.size(inner)),
    }


def pool_vectors(df: DataFrame, id_col: str, pos_col: str, vec_col: str, run: int = TOKEN_RUN) -> DataFrame:
    """``(id, cls, max, mean)`` from one row per token; positions are unique and start at 0.

    First each run of token positions is reduced, without and with its last
    token; then the few runs of a document are merged. Only the final run of a
    document leaves its last token out. No group ever exceeds ``run`` tokens.
    """
    tokens = df.select(
        F.col(id_col),
        F.expr(f"`{pos_col}` div {int(run)}").alias("_run"),
        F.struct(F.col(pos_col).alias("pos"), _as_double(F.col(vec_col)).alias("vec")).alias("_token"),
    )
    runs = tokens.groupBy(id_col, "_run").agg(F.sort_array(F.collect_list("_token")).alias("_tokens"))
    first = F.get(F.col("_tokens"), F.lit(0))
    # The token at position 0 belongs to cls alone.
    body = F.transform(F.filter(F.col("_tokens"), lambda t: t["pos"] > 0), lambda t: t["vec"])
    runs = runs.select(id_col, "_run", F.when(first["pos"] == 0, first["vec"]).alias("_cls"), body.alias("_body"))
    closed = F.slice(F.col("_body"), 1, F.greatest(F.size("_body") - 1, F.lit(0)))
    partial = runs.select(
        id_col,
        F.struct(
            F.col("_run").alias("run"),
            F.col("_cls").alias("cls"),
            F.size("_body").alias("n_all"),
            _fold(F.col("_body"), _add).alias("sum_all"),
            _fold(F.col("_body"), _greater).alias("max_all"),
            _fold(closed, _add).alias("sum_cut"),
            _fold(closed, _greater).alias("max_cut"),
        ).alias("_part"),
    )
    return pool_parts(partial, id_col)


def pool_parts(df: DataFrame, id_col: str) -> DataFrame:
    """``(id, cls, max, mean)`` of rows ``id, _part``, a part for each run of tokens of a text.

    A part is ``run, cls, n_all, sum_all, max_all, sum_cut, max_cut``, in the order of which parts come: the run's number, the text's first
    vector, and of the others number, sum and maximum, then the latter two without the last. Between ``run`` and ``cls`` may stand more.
    """
    merged = df.groupBy(id_col).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    parts = F.col("_parts")
    last = F.element_at(parts, -1)
    head = F.slice(parts, 1, F.size(parts) - 1)

    def across(whole: str, cut: str, merge) -> Column:
        vectors = F.array_append(F.transform(head, lambda p: p[whole]), last[cut])
        return _fold(F.filter(vectors, lambda v: v.isNotNull()), merge)

    n_inner = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + p["n_all"]) - 1
    total = across("sum_all", "sum_cut", _add)
    # Of the first run; where texts share an id, it may have several parts.
    first = F.array_min(F.transform(F.filter(parts, lambda p: p["run"].eqNullSafe(F.get(parts, F.lit(0))["run"])), lambda p: p["cls"]))
    return merged.select(
        id_col,
        first.alias("cls"),
        across("max_all", "max_cut", _greater).alias("max"),
        F.transform(total, lambda x: x / n_inner).alias("mean"),
    )


def pool_concat(names: Sequence[str]) -> Column:
    """Concatenation of the chosen pooled vectors, always in the order of ``POOLERS``.

    In place of a NULL vector stand as many NULLs as the others have numbers; NULL if all are.
    """
    chosen = [F.col(p) for p in POOLERS if p in names]
    if not chosen or set(names) - set(POOLERS):
        raise ValueError(f"choose from {POOLERS}: {names}")
    width = F.coalesce(*[F.when(c.isNotNull(), F.size(c)) for c in chosen])
    return F.concat(*[F.coalesce(c, F.array_repeat(F.lit(None), width)) for c in chosen])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0.0 if either norm is 0."""
    a, b = _as_double(a), _as_double(b)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def cosine_pairwise(df: DataFrame, embeddings: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds ``inspect_{pooler}``, the cosine of the source and target embedding of the same row, per pooler."""
    scores = {f"inspect_{p}": cosine(F.col(source), F.col(target)) for p, (source, target) in embeddings.items()}
    return df.withColumns(scores)


def pca_reduce(df: DataFrame, vec_col: str, k: int = 2, prefix: str = "pc") -> DataFrame:
    """Adds the first ``k`` principal coordinates ``pc0, pc1, ...`` of the centred vectors.

    The covariance is summed by the executors; only matrices of the size of one
    vector squared reach the driver. Each axis is turned so that its loading of
    greatest magnitude is positive.
    """
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = df.withColumn("_v", array_to_vector(_as_double(F.col(vec_col))))
    stages = [
        StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_scores"),
    ]
    model = Pipeline(stages=stages).fit(vectors.select("_v"))
    axes = np.asarray(model.stages[-1].pc.toArray())
    signs = [1.0 if axis[np.argmax(np.abs(axis))] >= 0 else -1.0 for axis in axes.T]
    scores = vector_to_array(F.col("_scores"))
    coords = {f"{prefix}{i}": scores[i] * sign for i, sign in enumerate(signs)}
    return model.transform(vectors).withColumns(coords).drop("_v", "_centred", "_scores")


def embedding_table(coords: DataFrame, clusters: DataFrame | None, key: str, keep: Sequence[str]) -> DataFrame:
    """Coordinates with code, label and, if given, the cluster name: the table behind the plots.

    A row without a cluster keeps its coordinates, with a NULL name.
    """
    from codepairs.functions.text import cluster_name

    table = coords.select(key, *keep, *[c for c in coords.columns if c.startswith("pc")])
    if clusters is None:
        return table
    named = clusters.select(key, cluster_name(F.col("cluster")).alias("label_type"))
    return table.join(named, key, "left")
