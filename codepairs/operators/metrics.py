"""Counts, confusion metrics and arg-max selections: all partial-then-final aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepairs.functions import text as X


def class_counts(long: DataFrame, by: Sequence[str] = ("node_type",), label: str = "label") -> DataFrame:
    """Positive and negative rows per node type."""
    return long.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative")
    )


def dataset_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def confusion_counts(long: DataFrame, by: Sequence[str] = ("node_type",), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """TN, FP, FN and TP per node type; classes that do not occur count as zero."""

    def cell(a: int, p: int) -> Column:
        return F.count_if((F.col(actual) == a) & (F.col(pred) == p))

    return long.groupBy(*by).agg(
        cell(0, 0).alias("true_negative"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(1, 1).alias("true_positive"),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def _one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], latest: bool) -> DataFrame:
    """The row at one end of ``order`` for each key.

    The first order column is reduced alone, which takes no sort, and whole rows
    are then compared only where they share its best value.
    """
    keys, first = X.columns(key), X.columns(order)[0]
    best = df.groupBy(*keys).agg((F.max if latest else F.min)(first).alias("_best"))
    best = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(best.columns[:-1])], "_best")
    same = [k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ties = df.join(best, [*same, first.eqNullSafe(F.col("_best"))]).select(*[df[c] for c in df.columns])
    pick = F.max_by if latest else F.min_by
    return ties.groupBy(*keys).agg(pick(F.struct("*"), F.struct(*X.columns(order))).alias("_row")).select("_row.*")


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row with the greatest ``order`` tuple of each key."""
    return _one_per_key(df, key, order, True)


def first_record_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each group."""
    return _one_per_key(df, [group], [order], False)


def latest_checkpoints(listing: DataFrame, path: str = "path") -> DataFrame:
    """From a listing of paths, the checkpoint directory with the greatest number of each node type."""
    found = listing.select(
        F.regexp_extract(path, "([a-z]+(?:_statement|_clause))", 1).alias("node_type"),
        F.regexp_extract(path, "^(.*checkpoint-[0-9]+)", 1).alias("checkpoint"),
        F.regexp_extract(path, "^.*checkpoint-([0-9]+)", 1).alias("_n"),
    ).filter((F.col("node_type") != "") & (F.col("_n") != ""))
    numbered = found.withColumn("step", F.col("_n").cast("bigint")).drop("_n")
    return latest_per_key(numbered, ["node_type"], ["step", "checkpoint"])


def longest_within_limit(df: DataFrame, key: str = "file", tokens: str = "token_count", strict: bool = True) -> DataFrame:
    """The key with the most tokens, first key on ties; one row, and an error under ``strict`` if there is none.

    Only the key and its count travel to the final task: one row from each map task.
    """
    best = df.agg(
        F.min_by(F.struct(key, tokens), F.struct(-F.col(tokens), F.col(key))).alias("_best")
    )
    if strict:
        missing = F.raise_error(F.lit("no record is within the limits"))
        best = best.select(F.coalesce("_best", missing).alias("_best"))
    return best.filter(F.col("_best").isNotNull()).select("_best.*")


def fetch_selected_group(df: DataFrame, selected: DataFrame, key: str = "file") -> DataFrame:
    """All rows of the selected key; ``selected`` is the one row of ``longest_within_limit``, so it is broadcast."""
    return df.join(F.broadcast(selected.select(key).limit(1)), key, "left_semi")


def train_manifest(df: DataFrame, batch: int, epochs: int) -> DataFrame:
    """Number of rows, of steps per epoch, and of warm-up steps (a tenth of all steps, rounded up)."""
    sized = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("steps", F.ceil(F.col("n_rows") / batch))
    return sized.withColumn("warmup_steps", F.ceil(F.col("steps") * epochs * F.lit(0.1)))


def align_columns(codes: DataFrame, vectors: DataFrame, key: str = "id", strict: bool = True) -> DataFrame:
    """Codes, labels and vectors that belong together, matched by key rather than by position.

    Under ``strict`` a key on one side only is an error; otherwise such rows are left out.
    """
    if not strict:
        return codes.join(vectors, key)
    left, right = codes.withColumn("_code", F.lit(True)), vectors.withColumn("_vector", F.lit(True))
    both = left.join(right, key, "full")
    alone = F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string")))
    checked = both.withColumn("_code", F.when(F.col("_code") & F.col("_vector"), F.lit(True)).otherwise(alone))
    return checked.filter("_code").drop("_code", "_vector")
