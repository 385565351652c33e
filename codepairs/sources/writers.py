"""Writers: partitioned directories, so that later reads prune by directory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.session import scratch_path

JSONL_PARTITIONS = ("lang", "partition")
PAIR_PARTITIONS = ("lang", "partition", "pruning_type")


def _by_directory(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Gathers the rows of each directory so that it gets few files; AQE splits the large ones."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def write_jsonl(df: DataFrame, root: str, partition_by: Sequence[str] = JSONL_PARTITIONS, mode: str = "errorifexists") -> None:
    """JSON Lines in UTF-8, non-ASCII kept as it is, NULLs written."""
    _by_directory(df, partition_by).write.mode(mode).partitionBy(*partition_by).option("ignoreNullFields", "false").json(root)


def write_pairs(df: DataFrame, root: str, partition_by: Sequence[str] = PAIR_PARTITIONS, mode: str = "errorifexists") -> None:
    """Pair sets as Parquet."""
    _by_directory(df, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(root)


def write_pairs_counted(df: DataFrame, root: str, by: Mapping[str, Sequence[str | None]], mode: str = "errorifexists") -> DataFrame:
    """Pair sets as Parquet, and ``n_rows`` for each of the named directories, counted while they are written.

    ``by`` gives the values of each partition column; a row with others is an error, and nothing is written. The counts are
    observed behind the last shuffle, so that a repeated task counts once.
    """
    places = list(product(*by.values()))
    hits = [reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, place, strict=True)]) for place in places]
    known = reduce(or_, hits, F.lit(False))
    checked = df.withColumn(next(iter(by)), F.when(known, F.col(next(iter(by)))).otherwise(F.raise_error(F.lit("a directory that was not named"))))
    seen = Observation()
    counted = _by_directory(checked, list(by)).observe(seen, *[F.count_if(hit).alias(f"n{i}") for i, hit in enumerate(hits)])
    counted.write.mode(mode).partitionBy(*by).parquet(root)
    rows = [(*place, seen.get[f"n{i}"]) for i, place in enumerate(places)]
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in by], T.StructField("n_rows", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


def write_jsonl_tree(
    df: DataFrame, root: str, by: Mapping[str, Sequence[str]], leaf: str | None = None, mode: str = "errorifexists"
) -> None:
    """The plain directory tree ``root/value/.../value.jsonl``, or ``.../value/{leaf}.jsonl`` with ``leaf``.

    For consumers that do not read ``key=value`` directories; each ``.jsonl`` is
    a directory of part files. The rows are first stored by directory in one
    pass, so each of the named combinations then reads its own rows only.
    """
    spark = df.sparkSession
    wanted = df
    for column, values in by.items():
        wanted = wanted.filter(F.col(column).isin(list(values)))
    staged = scratch_path(spark, "tree-stage")
    _by_directory(wanted, list(by)).write.partitionBy(*by).parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    for values in product(*by.values()):
        chosen = rows
        for column, value in zip(by, values, strict=True):
            chosen = chosen.filter(F.col(column) == value)
        path = "/".join([root, *values] + ([leaf] if leaf else [])) + ".jsonl"
        chosen.drop(*by).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report_csv(
    df: DataFrame, root: str, run_label: str, name: str, mode: str = "errorifexists", header: bool = True
) -> str:
    """CSV below ``root/run_label``; returns its path. The label is given, so a run can be repeated."""
    path = f"{root}/{run_label}/{name}"
    options = {"header": header, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)
    return path
