"""One binary classifier per node type, all of them trained together, epoch by epoch.

Texts become hashed token counts (JVM-side), damped and scaled to length one. A step
is one job, however many types and candidates there are: tasks add up the
gradients of all models over their rows, sums are merged in a tree, and the driver,
which holds the weights (types x candidates x features, all parameters), moves
them. After each epoch the models are checked on the validation rows in one
more job, and stored with their metrics as ``checkpoint-N``; of each type the best is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.functions.labels import label_encode
from codepairs.functions.text import TOKEN
from codepairs.operators.metrics import binary_metrics
from codepairs.operators.sampling import balanced_sample
from codepairs.session import settle

FEATURES = 4096
# Partial sums that one task of the tree merges.
FAN = 32

METRICS = (
    "node_type string, epoch int, reg_param double, true_negative bigint, false_positive bigint, false_negative bigint,"
    " true_positive bigint, accuracy double, precision double, recall double, f1_score double"
)
MODEL = f"{METRICS}, bias double, weights array<double>"


def token_buckets(text: Column, features: int = FEATURES) -> Column:
    """The bucket of every token, in order; null text has none."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def sparse_rows(column: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, bucket, value`` of lists of buckets: logarithms of one more than the counts, scaled to rows of length one."""
    column = column.fill_null([]) if column.null_count else column
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(column)), sizes)
    keys, counts = np.unique(rows * features + column.flatten().to_numpy().astype(np.int64), return_counts=True)
    row, bucket, value = keys // features, keys % features, np.log1p(counts)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(column)))
    return row, bucket, value / norm[row] if len(row) else value


def margins(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, kind: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rows times candidates: the scores of each row by the models of its own kind."""
    row, bucket, value = rows
    out = bias[kind].astype(np.float64)
    for c in range(weights.shape[1]):
        out[:, c] += np.bincount(row, weights=value * weights[kind[row], c, bucket], minlength=n)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _kinds(batch: pa.RecordBatch, types: Sequence[str]) -> np.ndarray:
    place = {t: i for i, t in enumerate(types)}
    return np.array([place[t] for t in batch.column("node_type").to_pylist()], dtype=np.int64)


def gradients(batch: pa.RecordBatch, types: Sequence[str], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows of a batch: per type and candidate the gradient of the loss, the bias last; and per type the number of rows."""
    kinds, n_types, n_cand, features = _kinds(batch, types), *weights.shape
    rows = sparse_rows(batch.column("buckets"), features)
    miss = _sigmoid(margins(rows, len(batch), kinds, weights, bias)) - batch.column("label").to_numpy()[:, None]
    out = np.zeros((n_types, n_cand, features + 1))
    for c in range(n_cand):
        flat = np.bincount(kinds[rows[0]] * features + rows[1], weights=rows[2] * miss[rows[0], c], minlength=n_types * features)
        out[:, c, :features] = flat.reshape(n_types, features)
        out[:, c, features] = np.bincount(kinds, weights=miss[:, c], minlength=n_types)
    return out, np.bincount(kinds, minlength=n_types)


def _partial(shared, types: Sequence[str]):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per task: what its rows add up to."""
        weights, bias = shared.value
        total, counts = np.zeros((*weights.shape[:2], weights.shape[2] + 1)), np.zeros(len(types), dtype=np.int64)
        for batch in batches:
            added, seen = gradients(batch, types, weights, bias)
            total += added
            counts += seen
        sums = np.concatenate([counts.astype(np.float64), total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["part", "sums"])

    return partial


def _merged(group: pa.Table) -> pa.Table:
    """Partial sums in the order of their numbers, so that a repeated run adds up alike."""
    order = np.argsort(group.column("part").to_numpy(), kind="stable")
    rows = group.column("sums").to_pylist()
    total = np.zeros(len(rows[0]))
    for i in order.tolist():
        total += np.array(rows[i])
    return pa.table([pa.array([int(group.column("part")[0].as_py()) // FAN], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["part", "sums"])


def tree_sum(partials: DataFrame, tasks: int) -> np.ndarray:
    """The sum of one array per task, merged ``FAN`` at a time; one array reaches the driver."""
    while True:
        partials = partials.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merged, "part long, sums array<double>")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return np.array(partials.first()["sums"])


@dataclass
class Classifiers:
    """The kept model of each type: ``node_type -> (bias, weights)``, and the metrics of every epoch."""

    models: dict[str, tuple[float, list[float]]]
    history: DataFrame


def _counts(shared, types: Sequence[str], candidates: Sequence[float], epoch: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task, type and candidate: true negatives, false positives, false negatives, true positives."""
        weights, bias = shared.value
        found = np.zeros((len(types), len(candidates), 4), dtype=np.int64)
        for batch in batches:
            kinds = _kinds(batch, types)
            z = margins(sparse_rows(batch.column("buckets"), weights.shape[2]), len(batch), kinds, weights, bias)
            actual = batch.column("label").to_numpy()
            for c in range(len(candidates)):
                np.add.at(found, (kinds, c, 2 * actual + (z[:, c] >= 0)), 1)
        at = [(t, c) for t in range(len(types)) for c in range(len(candidates))]
        columns = [pa.array([types[t] for t, _ in at], pa.string()), pa.array([epoch] * len(at), pa.int32()), pa.array([candidates[c] for _, c in at], pa.float64())]
        columns += [pa.array([int(found[t, c, i]) for t, c in at], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["node_type", "epoch", "reg_param", "true_negative", "false_positive", "false_negative", "true_positive"])

    return counts


def train_by_epoch(
    train: DataFrame,
    valid: DataFrame,
    node_types: Sequence[str],
    use_size: int,
    id_col: str,
    text_col: str = "text",
    seed: int = 42,
    features: int = FEATURES,
    candidates: Sequence[float] = (1e-3, 1e-4),
    epochs: int = 5,
    steps: int = 6,
    save_root: str | None = None,
) -> Classifiers:
    """Logistic models with L2 penalties ``candidates``, by accelerated gradients, ``steps`` to an epoch.

    Training and validation rows are balanced samples of ``use_size`` at most per type. The model kept of a type is that with
    the best validation accuracy, of equal ones that of the earlier epoch, then of the earlier candidate. With ``save_root``, all
    models of epoch N are stored at ``save_root/checkpoint-N`` with their metrics. A type without
    rows of both classes gets no model.
    """
    spark = train.sparkSession

    def prepared(df: DataFrame, name: str, draw: int) -> DataFrame:
        rows = balanced_sample(df, node_types, use_size, id_col, text_col, draw)
        return settle(rows.select("node_type", "label", token_buckets(F.col("sentence"), features).alias("buckets")), name)

    fit, check = prepared(train, "train-rows", seed), prepared(valid, "valid-rows", seed + 1)
    present = {r["node_type"] for r in fit.select("node_type").distinct().collect()}  # a row per type at most
    types = [t for t in dict.fromkeys(node_types) if t in present]
    if not types:
        return Classifiers({}, spark.createDataFrame([], METRICS))
    check = check.filter(F.col("node_type").isin(types))
    tasks = max(1, fit.rdd.getNumPartitions())
    shape = (len(types), len(candidates), features + 1)
    here, ahead, pace = np.zeros(shape), np.zeros(shape), 1.0
    penalty = np.array(candidates)[None, :, None] * np.ones(shape)
    penalty[:, :, features] = 0.0  # the bias is free
    # Rows have length one and a bias: the loss curves by half at most.
    rate = 1 / (0.5 + penalty.max())
    best: dict[str, tuple] = {}
    history = None
    for epoch in range(1, epochs + 1):
        for _ in range(steps):
            shared = spark.sparkContext.broadcast((ahead[:, :, :features], ahead[:, :, features]))
            sums = tree_sum(fit.mapInArrow(_partial(shared, types), "part long, sums array<double>"), tasks)
            shared.unpersist()
            rows, slope = sums[: len(types)], sums[len(types) :].reshape(shape)
            moved = ahead - rate * (slope / rows[:, None, None] + penalty * ahead)
            after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, here, pace = moved + (pace - 1) / after * (moved - here), moved, after
        shared = spark.sparkContext.broadcast((here[:, :, :features], here[:, :, features]))
        schema = "node_type string, epoch int, reg_param double, true_negative bigint, false_positive bigint, false_negative bigint, true_positive bigint"
        found = check.mapInArrow(_counts(shared, types, list(candidates), epoch), schema).groupBy("node_type", "epoch", "reg_param")
        found = found.agg(*[F.sum(c).alias(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive")])
        told = binary_metrics(found).select(*[f.name for f in T._parse_datatype_string(METRICS).fields]).collect()  # a row per type and candidate
        rows_of = []
        for r in told:
            t, c = types.index(r["node_type"]), list(candidates).index(r["reg_param"])
            rows_of.append((*r, float(here[t, c, features]), here[t, c, :features].tolist()))
            rank = (r["accuracy"], -epoch, -c)
            if r["node_type"] not in best or rank > best[r["node_type"]][0]:
                best[r["node_type"]] = (rank, (float(here[t, c, features]), here[t, c, :features].tolist()))
        for t, name in enumerate(types):
            # Without validation rows the last epoch's first candidate stands.
            if not any(r["node_type"] == name for r in told):
                best[name] = ((0.0, -epoch, 0), (float(here[t, 0, features]), here[t, 0, :features].tolist()))
        if save_root:
            spark.createDataFrame(rows_of, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{save_root}/checkpoint-{epoch}")
        table = spark.createDataFrame([tuple(r) for r in told], METRICS)
        history = table if history is None else history.unionByName(table)
    return Classifiers({t: best[t][1] for t in types}, history)


def stored_classifiers(spark: SparkSession, root: str, epoch: int | None = None) -> dict[str, tuple[float, list[float]]]:
    """The best model of each type below ``root``, over all epochs or of one."""
    rows = spark.read.schema(MODEL).parquet(f"{root}/checkpoint-{'*' if epoch is None else epoch}")
    first = F.struct(-F.col("accuracy"), "epoch", -F.col("reg_param"))
    kept = rows.groupBy("node_type").agg(F.min_by(F.struct("bias", "weights"), first).alias("m"))
    return {r["node_type"]: (r["m"]["bias"], r["m"]["weights"]) for r in kept.collect()}  # a row per type


def classify_trained(models: dict[str, tuple[float, list[float]]], df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``{T}-inference`` (1/0) and ``{T}-score`` (of the predicted class) for every model, texts read once for all."""
    names = list(models)
    if not names:
        return df
    weights = np.array([models[t][1] for t in names])
    shared = df.sparkSession.sparkContext.broadcast((weights, np.array([models[t][0] for t in names])))
    features = weights.shape[1]

    @F.pandas_udf("array<double>")
    def chances(buckets):
        import pandas as pd

        w, bias = shared.value
        column = pa.array([x if x is not None else [] for x in buckets], pa.list_(pa.int32()))
        row, bucket, value = sparse_rows(column, features)
        z = np.stack([np.bincount(row, weights=value * w[t, bucket], minlength=len(column)) + bias[t] for t in range(len(w))], axis=1)
        return pd.Series(list(_sigmoid(z)))

    scored = df.withColumn("_p", chances.asNondeterministic()(token_buckets(F.col(text_col), features)))
    columns = {}
    for i, t in enumerate(names):
        p = F.col("_p")[i]
        columns[f"{t}-inference"] = label_encode(F.when(p >= 0.5, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")))
        columns[f"{t}-score"] = F.greatest(p, 1 - p)
    return scored.withColumns(columns).drop("_p")
