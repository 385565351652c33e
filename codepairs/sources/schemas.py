"""Explicit schemas of the inputs, and the check for missing fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.functions.text import backticked

S, A = T.StringType(), T.ArrayType(T.StringType())


def fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


SUBTREE_ELEMENT = fields(repo=S, path=S, func_name=S, language=S, code=S, subtree_elements_unique=A)
SUBTREE_EDIT = fields(
    original_code=S, edited_code=S, delete_target_node=S, original_ast_node_types=A, edited_ast_node_types=A
)
CHAR_PAIR = fields(cleaned_code=S, edited_code=S, cos_sim_diff_char=T.DoubleType())
AST_PAIR = fields(cleaned_code=S, edited_code=S, cos_sim_diff_node=T.DoubleType())
NESTED_EDIT = fields(
    filename=S,
    original_code=S,
    num_of_nodes=T.LongType(),
    edited_code=T.ArrayType(fields(code=S, count=T.LongType())),
)
LABELLED_CODE = fields(code=S, label=S)
PAIR_SET = fields(guid=S, source=S, target=S, label=T.DoubleType(), lang=S, partition=S, pruning_type=S)


def labelled_text(node_types: Sequence[str]) -> T.StructType:
    """Records written by the labelling step: text plus one 0/1 column per node type."""
    flags = {t: T.IntegerType() for t in node_types}
    return fields(repo=S, path=S, func_name=S, lang=S, text=S, **flags)


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A NULL in a required field becomes an error as soon as that field is used."""
    checked = {
        n: F.coalesce(backticked(n), F.raise_error(F.lit(f"missing field: {n}"))) for n in names
    }
    return df.withColumns(checked)


def split_incomplete(df: DataFrame, names: Sequence[str], corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``: rows with every required field, and the others."""
    bad = F.lit(False)
    for n in names:
        bad = bad | backticked(n).isNull()
    if corrupt in df.columns:
        bad = bad | F.col(corrupt).isNotNull()
    return df.filter(~bad).drop(corrupt), df.filter(bad)
