"""Labels, flags and edit measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names of the two labels.
POSITIVE, NEGATIVE = "POSITIVE", "NEGATIVE"

# The node types studied by default.
NODE_TYPES = (
    "if_statement",
    "elif_clause",
    "else_clause",
    "for_statement",
    "while_statement",
    "expression_statement",
    "return_statement",
    "break_statement",
    "with_statement",
)

# Node types whose deletion is never counted among the others.
STOP_TYPES = ("function_definition", "block", "module")


def contains(types: Column, wanted: Column | str) -> Column:
    """Membership that is false, not NULL, for a NULL array or an array holding NULL."""
    return F.coalesce(F.array_contains(types, wanted), F.lit(False))


def multi_hot(types: Column, requested: Sequence[str]) -> list[Column]:
    """One 0/1 column per requested node type, in the order of the request."""
    return [contains(types, t).cast("int").alias(t) for t in requested]


def label_encode(label: Column) -> Column:
    """POSITIVE to 1 and NEGATIVE to 0; any other label is an error."""
    return (
        F.when(label == POSITIVE, F.lit(1))
        .when(label == NEGATIVE, F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))).cast("int"))
    )


def label_decode(code: Column) -> Column:
    """1 to POSITIVE and 0 to NEGATIVE; any other code is an error."""
    return (
        F.when(code == 1, F.lit(POSITIVE))
        .when(code == 0, F.lit(NEGATIVE))
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(code.cast("string"), F.lit("NULL")))).cast("string")
        )
    )


def judge(predicted: Column, actual: Column, style: str = "text") -> Column:
    """Whether a prediction is right, as ``CORRECT``/``INCORRECT`` or as 1/0."""
    right, wrong = {"text": ("CORRECT", "INCORRECT"), "int": (1, 0)}[style]
    return F.when(predicted == actual, F.lit(right)).otherwise(F.lit(wrong))


def sym_diff(a: Column, b: Column) -> Column:
    """Elements that occur in exactly one of two arrays, without repeats."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def in_sym_diff(value: Column, a: Column, b: Column) -> Column:
    """Membership in ``sym_diff`` without building it."""
    return contains(a, value) != contains(b, value)


def edit_similarity_label(nodes: Column, deleted: Column, strict: bool = True) -> Column:
    """Square of the share of nodes kept, less one, to 3 places: 0 for no deletion, -1 for all.

    ``nodes = 0`` is an error under ``strict`` and NULL otherwise.
    """
    share = deleted / nodes if strict else F.try_divide(deleted, nodes)
    kept = F.lit(1.0) - share
    return F.bround(kept * kept - 1, 3)


def edit_bucket(deleted: Column, original: Column, edited: Column, targets: Sequence[str], stops: Sequence[str] = STOP_TYPES) -> Column:
    """``target`` or ``others`` for an edit whose deleted node type really went (or came); else NULL.

    The target test comes first: a stop type listed as a target is a target.
    """
    kind = F.when(deleted.isin(list(targets)), F.lit("target")).when(~deleted.isin(list(stops)), F.lit("others"))
    return F.when(in_sym_diff(deleted, original, edited), kind)
