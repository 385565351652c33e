"""Embedding analysis: snippets are encoded, pooled, reduced, clustered and compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from codepairs.operators.clustering import density_cluster
from codepairs.operators.models import batch_encode_pooled
from codepairs.operators.similarity import cosine_all_pairs
from codepairs.operators.vectors import embedding_table, pca_reduce
from codepairs.session import settle


def embed(snippets: DataFrame, code: str = "code", pooling: str = "cls", make_fn: Callable | None = None) -> DataFrame:
    """Adds ``embedding``, the pooled token matrix of each snippet; stored, so that the encoder runs once."""
    return settle(batch_encode_pooled(snippets, code, "embedding", pooling, make_fn), "embedded")


def analyse(
    embedded: DataFrame, id_col: str, threshold: float, min_pts: int, dim: int = 2, code: str = "code", label: str = "label"
) -> DataFrame:
    """``(id, code, label, pc0.., label_type)`` for every embedded snippet."""
    clusters = density_cluster(embedded, id_col, "embedding", threshold, min_pts)
    return embedding_table(pca_reduce(embedded, "embedding", dim), clusters, id_col, [code, label])


def cosine_matrix(embedded: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """The cosine of every pair of snippets, by label."""
    return cosine_all_pairs(embedded, id_col, label, "embedding").select("index", "source", "target", "cosSim")
