"""Subtree detection: records are labelled, sampled, classified and scored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.functions import labels as L
from codepairs.functions.text import backticked
from codepairs.operators.metrics import binary_metrics, confusion_counts, latest_checkpoints
from codepairs.operators.models import batch_classify, classify_with
from codepairs.operators.records import label_records, melt_by_type, route_edits
from codepairs.operators.sampling import sample_n
from codepairs.session import settle
from codepairs.sources.readers import list_paths, read_jsonl_partitions
from codepairs.sources.schemas import SUBTREE_ELEMENT
from codepairs.sources.writers import write_jsonl, write_report_csv


def prepare(spark, input_root: str, output_root: str, node_types: Sequence[str] = L.NODE_TYPES) -> None:
    """Corpus tree to labelled records, one scan for all languages and partitions.

    ``lang`` is the directory a record lies in, which is also where it is written.
    """
    raw = read_jsonl_partitions(spark, input_root, SUBTREE_ELEMENT)
    labelled = label_records(raw.withColumn("language", F.col("lang")), node_types, keep=["partition"])
    write_jsonl(labelled, output_root)


def store_models(models: dict, root: str, run_label: str, step: int) -> None:
    """One directory per node type, named like those of training runs: ``base_{type}_{run}/checkpoint-{step}``."""
    for node_type, model in models.items():
        model.write().overwrite().save(f"{root}/base_{node_type}_{run_label}/checkpoint-{step}")


def newest_models(spark: SparkSession, root: str) -> dict:
    """The model of the newest checkpoint below ``root`` for each node type, found by listing the files."""
    newest = latest_checkpoints(list_paths(spark, root))
    # One row per node type.
    return {r["node_type"]: PipelineModel.load(r["checkpoint"]) for r in newest.orderBy("node_type").collect()}


def report_with_newest(labelled: DataFrame, root: str, id_col: str, sample_size: int = 2500, text: str = "text", seed: int = 42) -> DataFrame:
    """Metrics per node type of the models that ``newest_models`` finds, on a sample of labelled records."""
    models = newest_models(labelled.sparkSession, root)
    return score(classify_with(models, sample_n(labelled, sample_size, id_col, seed, strict=False), text), list(models))


def with_judgements(scored: DataFrame, node_types: Sequence[str], style: str) -> DataFrame:
    """Adds ``{T}-judge`` for each node type: the wide inference table."""
    return scored.withColumns(
        {f"{t}-judge": L.judge(backticked(f"{t}-inference"), backticked(t), style) for t in node_types}
    )


def score(scored: DataFrame, node_types: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    long = melt_by_type(scored, node_types, by, {"actual": "", "pred": "-inference"})
    return binary_metrics(confusion_counts(long, [*by, "node_type"]))


def inference_table(
    labelled: DataFrame, classifiers: dict[str, Callable], id_col: str, sample_size: int = 2500, text: str = "text", seed: int = 42
) -> DataFrame:
    """A sample of labelled records with inference, score and judgement per node type."""
    rows = sample_n(labelled, sample_size, id_col, seed)
    return with_judgements(batch_classify(rows, classifiers, text), list(classifiers), "text")


def evaluate_sample(
    labelled: DataFrame, classifiers: dict[str, Callable], id_col: str, sample_size: int = 2500, text: str = "text", seed: int = 42
) -> DataFrame:
    """Metrics per node type on a sample of labelled records."""
    return score(inference_table(labelled, classifiers, id_col, sample_size, text, seed), list(classifiers))


def edit_table(
    edits: DataFrame, classifiers: dict[str, Callable], stops: Sequence[str] = L.STOP_TYPES, keep: Sequence[str] = ()
) -> DataFrame:
    """Routed edits with inference, score and 1/0 judgement per node type; ``bucket`` tells target from others."""
    targets = list(classifiers)
    return with_judgements(batch_classify(route_edits(edits, targets, stops, keep), classifiers), targets, "int")


def evaluate_edits(edits: DataFrame, classifiers: dict[str, Callable], stops: Sequence[str] = L.STOP_TYPES) -> DataFrame:
    """Metrics per node type on edited records, target and other deletions apart, in one pass."""
    return score(edit_table(edits, classifiers, stops), list(classifiers), ["bucket"])


def write_reports(table: DataFrame, node_types: Sequence[str], root: str, run_label: str, by: Sequence[str] = ()) -> tuple[str, str]:
    """Stores an inference table once and writes it and its metrics as CSV; arrays become JSON text."""
    stored = settle(table, "inference")
    texts = {
        f.name: F.to_json(f.name) for f in stored.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    flat = stored.withColumns(texts) if texts else stored
    inference = write_report_csv(flat, root, run_label, "inference.csv")
    return inference, write_report_csv(score(stored, node_types, by), root, run_label, "evaluate.csv")
