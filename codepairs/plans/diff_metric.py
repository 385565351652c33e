"""Diff metric: pairs are built, sampled into a training set, and inspected by cosine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepairs.functions.text import flatten_ws, report_name
from codepairs.operators.metrics import fetch_selected_group, first_record_per_group, longest_within_limit
from codepairs.operators.models import batch_embed_pairs, token_counts
from codepairs.operators.records import explode_edits, length_filter, make_pairs
from codepairs.operators.sampling import sample_per_group, seeded_shuffle
from codepairs.operators.vectors import cosine_pairwise
from codepairs.session import settle
from codepairs.sources.readers import read_nested_json, read_pair_tree
from codepairs.sources.schemas import AST_PAIR, CHAR_PAIR
from codepairs.sources.writers import write_pairs, write_report_csv

PROGRAM_BYTES = 16 << 20


def prepare(spark, input_root: str, output_root: str, flavour: str = "char") -> None:
    """Corpus tree to stored pair sets, one scan for all directories."""
    raw = read_pair_tree(spark, input_root, CHAR_PAIR if flavour == "char" else AST_PAIR)
    write_pairs(make_pairs(raw, flavour, keep=["lang", "partition", "pruning_type"]), output_root)


def prepare_nested(spark, input_root: str, output_root: str, nested: bool = False) -> None:
    """Nested edits to stored pairs, one row per pair, or one per program with its pairs as an array."""
    edits = explode_edits(read_nested_json(spark, input_root), nested=nested)
    # Every pair holds its program: a dictionary of this size holds each program of a row group once.
    edits.write.option("parquet.dictionary.page.size", PROGRAM_BYTES).parquet(output_root)


def training_set(
    pairs: DataFrame,
    pruning_types: Sequence[str],
    per_type: int | None,
    id_col: str,
    batch: int,
    seed: int = 42,
    epoch: int = 0,
    strict: bool = True,
) -> DataFrame:
    """A sample of each pruning type, shuffled together and cut into batches."""
    sampled = sample_per_group(pairs, "pruning_type", pruning_types, per_type, id_col, seed, strict)
    if per_type:
        # A bounded sample is stored, so that the shuffle does not draw it twice.
        sampled = settle(sampled, "sampled")
    return seeded_shuffle(sampled, id_col, batch, seed, epoch)


def inspect_longest(
    rows: DataFrame,
    order: str,
    encoders: dict[str, Callable],
    file: str = "file",
    max_chars: int = 800,
    max_tokens: int = 510,
    tokenizer: Callable | None = None,
) -> DataFrame:
    """Cosine of every pair of the longest program that fits the limits, once per encoder."""
    first = first_record_per_group(rows.select(file, order, "cleaned_code"), file, order)
    fitting = length_filter(token_counts(first, "cleaned_code", tokenizer=tokenizer), "cleaned_code", "token_count", max_chars, max_tokens)
    chosen = fetch_selected_group(rows, longest_within_limit(fitting, file), file)
    flat = chosen.withColumns(
        {"flattened_code": flatten_ws(F.col("cleaned_code")), "flattened_edited_code": flatten_ws(F.col("edited_code"))}
    )
    both = batch_embed_pairs(flat, "flattened_code", "flattened_edited_code", encoders, "_found")
    return cosine_pairwise(both, {p: (f"_found.`{p}-source`", f"_found.`{p}-target`") for p in encoders}).drop("_found")


def write_inspection(report: DataFrame, root: str, run_label: str, set_names: Sequence[str], poolers: Sequence[str]) -> str:
    """Writes an inspection below ``root``, in a file named after the run, the sets and the poolers."""
    name = report_name(F.lit(run_label), F.array(*map(F.lit, set_names)), F.array(*map(F.lit, poolers)))
    # One row: the name itself.
    file = report.sparkSession.range(1).select(name.alias("name")).first()["name"]
    return write_report_csv(report, root, run_label, file)
