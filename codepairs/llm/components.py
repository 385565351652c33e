"""Connected components of links, and spanning forests of small blocks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from codepairs.operators.components import connected_components


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes (``u`` and ``v``) of ``edges``; the component is its smallest node."""
    return connected_components(edges.filter("u <> v")).withColumnRenamed("root", "component")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric matrix of links, each node that is not the first of its component, with that first node."""
    root = np.full(len(near), -1)
    for start in np.flatnonzero(near.any(axis=1)):
        if root[start] < 0:
            root[start] = start
            front = np.array([start])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[front] = start
    node = np.flatnonzero((root >= 0) & (root != np.arange(len(near))))
    return node, root[node]
