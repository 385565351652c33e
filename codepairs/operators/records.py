"""Row-wise shaping of code records; none of these operators shuffles, save ``widen_by_type``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepairs.functions import labels as L
from codepairs.functions import text as X

# Renames of the two record flavours, old name to new name.
CLEAN_RENAMES = {"repo": "repo", "path": "path", "func_name": "func_name", "language": "lang", "code": "text"}
EDIT_RENAMES = {
    "original_code": "original",
    "original_ast_node_types": "original_ast_node_types",
    "edited_code": "text",
    "edited_ast_node_types": "edited_ast_node_types",
    "delete_target_node": "delete_target_node",
}

# Label column and white-space treatment of the two pair flavours.
PAIR_LABELS = {"char": "cos_sim_diff_char", "ast": "cos_sim_diff_node"}


def project_rename(df: DataFrame, renames: dict[str, str] = CLEAN_RENAMES, keep: Sequence[str] = ()) -> DataFrame:
    """Keep and rename the columns of a record flavour; ``keep`` passes further columns through."""
    return df.select(*[X.backticked(old).alias(new) for old, new in renames.items()], *X.columns(keep))


def label_records(df: DataFrame, node_types: Sequence[str], types_col: str = "subtree_elements_unique", keep: Sequence[str] = ()) -> DataFrame:
    """Clean flavour: renamed columns, comments stripped, one 0/1 column per node type."""
    shaped = [
        (X.strip_comments(F.col(old)) if new == "text" else F.col(old)).alias(new) for old, new in CLEAN_RENAMES.items()
    ]
    return df.select(*shaped, *X.columns(keep), *L.multi_hot(F.col(types_col), node_types))


def route_edits(df: DataFrame, targets: Sequence[str], stops: Sequence[str] = L.STOP_TYPES, keep: Sequence[str] = ()) -> DataFrame:
    """Edit flavour: renamed columns, 0/1 columns from the edited types, and ``bucket`` (target / others).

    Edits whose deleted type is in both lists or in neither, and stop types, are dropped.
    """
    bucket = L.edit_bucket(
        F.col("delete_target_node"), F.col("original_ast_node_types"), F.col("edited_ast_node_types"), targets, stops
    )
    return (
        df.withColumn("bucket", bucket)
        .filter(F.col("bucket").isNotNull())
        .select(
            *[X.backticked(old).alias(new) for old, new in EDIT_RENAMES.items()],
            *X.columns(keep),
            *L.multi_hot(F.col("edited_ast_node_types"), targets),
            "bucket",
        )
    )


def make_pairs(
    df: DataFrame,
    flavour: str = "char",
    source: str = "cleaned_code",
    target: str = "edited_code",
    label: str | None = None,
    guid_cols: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(guid, source, target, label)``; the char flavour flattens white space, the AST flavour keeps the raw text.

    Without ``guid_cols`` the guid is the constant ``index``; with them it is a
    stable digest of those columns.
    """
    shape = X.flatten_ws if flavour == "char" else (lambda c: c)
    guid = F.sha2(F.concat_ws(":", *[c.cast("string") for c in X.columns(guid_cols)]), 256) if guid_cols else F.lit("index")
    return df.select(
        *X.columns(keep),
        guid.alias("guid"),
        shape(F.col(source)).alias("source"),
        shape(F.col(target)).alias("target"),
        F.col(label or PAIR_LABELS[flavour]).cast("double").alias("label"),
    )


def _edit_pair(edit: Column, num: Column, strict: bool) -> Column:
    return F.struct(
        F.concat_ws("-", F.col("filename"), num.cast("string")).alias("guid"),
        F.col("original_code").alias("source"),
        edit["code"].alias("target"),
        L.edit_similarity_label(F.col("num_of_nodes"), edit["count"], strict).alias("label"),
    )


def explode_edits(df: DataFrame, nested: bool = False, strict: bool = True) -> DataFrame:
    """One pair per element of ``edited_code``; ``nested`` keeps one array of pairs per file instead."""
    if nested:
        pairs = F.transform(F.col("edited_code"), lambda edit, num: _edit_pair(edit, num, strict))
        return df.select("filename", pairs.alias("pairs"))
    rows = df.select("filename", "original_code", "num_of_nodes", F.posexplode("edited_code").alias("num", "edit"))
    return rows.select("filename", "num", _edit_pair(F.col("edit"), F.col("num"), strict).alias("pair")).select(
        "filename", "num", "pair.*"
    )


def melt_by_type(df: DataFrame, node_types: Sequence[str], id_cols: Sequence[str], parts: dict[str, str] | None = None) -> DataFrame:
    """Wide to long: one row per record and node type.

    ``parts`` maps each output column to the suffix of its wide columns, e.g.
    ``{"actual": "", "pred": "-inference"}``.
    """
    parts = parts or {"label": ""}
    entries = [
        F.struct(F.lit(t).alias("node_type"), *[X.backticked(t + suffix).alias(out) for out, suffix in parts.items()])
        for t in node_types
    ]
    return df.select(*X.columns(id_cols), F.inline(F.array(*entries)))


def widen_by_type(
    df: DataFrame, node_types: Sequence[str], id_cols: Sequence[str], parts: Sequence[str] = ("inference", "score", "judge")
) -> DataFrame:
    """Long to wide: columns ``{T}-{part}`` for each requested node type, one row per record.

    Plain conditional aggregates, so partial aggregation runs before the one shuffle.
    """
    cells = [
        F.max(F.when(F.col("node_type") == t, F.col(part))).alias(f"{t}-{part}") for t in node_types for part in parts
    ]
    return df.groupBy(*X.columns(id_cols)).agg(*cells)


def split_by_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of the two classes only; the label column tells them apart."""
    return df.filter(X.backticked(label).isin(0, 1))


def length_filter(df: DataFrame, code: str = "code", tokens: str = "token_count", max_chars: int = 800, max_tokens: int = 510) -> DataFrame:
    return df.filter(X.within_limits(F.col(code), F.col(tokens), max_chars, max_tokens))


def union_sets(*frames: DataFrame) -> DataFrame:
    """Concatenation by column name, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), frames)
