"""All queries of this subpackage: importing an operator's module registers its query."""

from __future__ import annotations

from codepairs.llm import centroids, line_dedup, minhash, mixing, negatives, neighbours, packing, quality, secrets, suffix_dedup, vector_dedup, warc, windows  # noqa: F401
from codepairs.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
