"""Readers. Directory names become columns in the one scan that reads all files.

A ``*.jsonl`` entry may be a single file or a directory of part files. All files
are split among tasks: JSON Lines at line breaks, whole-document JSON and CSV with
line breaks inside quotes by the automata of ``ranges``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.functions.text import decoded_uri
from codepairs.session import settle
from codepairs.sources.ranges import SPLIT_BYTES, CsvAutomaton, JsonAutomaton, chunks, list_files, ranged_records
from codepairs.sources.schemas import LABELLED_CODE, NESTED_EDIT, PAIR_SET, require

# The directory that stands for null.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
CORRUPT = "_corrupt_record"
# Bytes read at a time for a first line, and files of a task that reads first lines.
FIRST_BYTES = 64 << 10
FILES_PER_TASK = 200
# What a path pattern takes for more than itself.
GLOB = re.compile(r"[\[\]{}*?\\]")


def _one_of(names: Sequence[str] | None) -> str:
    if not names:
        return "*"
    return names[0] if len(names) == 1 else "{" + ",".join(names) + "}"


def _file_path() -> Column:
    return decoded_uri(F.col("_metadata.file_path"))


def _json(spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool, path_columns: dict[str, Column], **options) -> DataFrame:
    """Strict reads fail on a bad line or a missing field; others keep bad lines in ``_corrupt_record``."""
    if strict:
        rows = spark.read.schema(schema).options(mode="FAILFAST", **options).json(paths)
        return require(rows.select(*schema.names, *[c.alias(n) for n, c in path_columns.items()]), schema.names)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).json(paths)
    return rows.select(*wide.names, *[c.alias(n) for n, c in path_columns.items()])


def _part(pattern: str) -> Column:
    return F.nullif(F.regexp_extract(_file_path(), pattern, 1), F.lit(NULL_NAME))


def read_jsonl_partitions(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    langs: Sequence[str] | None = None,
    partitions: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """``root/lang/partition.jsonl``, with ``lang`` and ``partition`` (the file name up to its first dot).

    Requested languages and partitions narrow the file listing itself.
    """
    names = "*.jsonl" if not partitions else _one_of([n for p in partitions for n in (f"{p}.jsonl", f"{p}.*.jsonl")])
    path = f"{root}/{_one_of(langs)}/{names}"
    lang = _part(r"^.*/([^/]+)/[^/]+\.jsonl(?:/[^/]+)?$")
    partition = _part(r"^.*/([^/.]*)[^/]*\.jsonl(?:/[^/]+)?$")
    return _json(spark, path, schema, strict, {"lang": lang, "partition": partition})


def read_pair_tree(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    langs: Sequence[str] | None = None,
    partitions: Sequence[str] | None = None,
    pruning_types: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """``root/lang/partition/pruning_type/*.jsonl`` with three path columns and the ``file`` name."""
    path = f"{root}/{_one_of(langs)}/{_one_of(partitions)}/{_one_of(pruning_types)}/*.jsonl"
    tail = r"/[^/]+\.jsonl(?:/[^/]+)?$"
    columns = {
        "lang": _part(rf"^.*/([^/]+)/[^/]+/[^/]+{tail}"),
        "partition": _part(rf"^.*/([^/]+)/[^/]+{tail}"),
        "pruning_type": _part(rf"^.*/([^/]+){tail}"),
        "file": _part(r"^.*/([^/]+\.jsonl)(?:/[^/]+)?$"),
    }
    return _json(spark, path, schema, strict, columns)


def read_jsonl_dir(
    spark: SparkSession, root: str, lang: str, partition: str, schema: T.StructType, strict: bool = True
) -> DataFrame:
    """All ``root/lang/partition/*.jsonl`` as one set."""
    return _json(spark, f"{root}/{lang}/{partition}/*.jsonl", schema, strict, {})


def read_jsonl_file(
    spark: SparkSession, root: str, lang: str, partition: str, schema: T.StructType, strict: bool = True
) -> DataFrame:
    """The one ``root/lang/partition.jsonl``."""
    return _json(spark, f"{root}/{lang}/{partition}.jsonl", schema, strict, {})


def read_nested_json(
    spark: SparkSession, root: str, schema: T.StructType = NESTED_EDIT, strict: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``root/*.json``, an object or an array of objects per file.

    An array is read by as many tasks as its file has ranges of ``split_bytes``; an object by one. A faulty element or a file that
    ends too early is an error under ``strict``; otherwise the element's text is kept in ``_corrupt_record``.
    """
    records = ranged_records(spark, f"{root}/*.json", JsonAutomaton, split_bytes, balanced=strict)
    if strict:
        rows = records.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("_json"))
        return require(rows.select("_json.*"), schema.names)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("record", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return records.select(parsed.alias("_json")).select("_json.*")


def read_labelled_csv(spark: SparkSession, path: str, strict: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Headerless CSV: first column code, second label, any others ignored.

    Fields may hold quotes and line breaks; all line breaks come out as ``\\n``. A row without a label is an error
    under ``strict`` and keeps a NULL label otherwise. A file is read by as many tasks as it has ranges of ``split_bytes``.
    """
    wide = f"{LABELLED_CODE.toDDL()}, {CORRUPT} STRING"
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}
    records = ranged_records(spark, path, CsvAutomaton, split_bytes)
    rows = records.select(F.from_csv("record", wide, options).alias("_row")).select("_row.*")
    rows = rows.withColumns(
        {
            "code": F.regexp_replace("code", "\r\n?", "\n"),
            "label": F.regexp_replace(F.regexp_replace("label", "\r$", ""), "\r\n?", "\n"),
        }
    )
    # An empty field reads as NULL; only a row of the wrong length is also marked corrupt.
    short = F.col("label").isNull() & F.col(CORRUPT).isNotNull()
    missing = F.raise_error(F.lit("row without a label")).cast("string") if strict else F.lit(None).cast("string")
    return rows.select(
        F.coalesce("code", F.lit("")).alias("code"),
        F.when(short, missing).otherwise(F.coalesce("label", F.lit(""))).alias("label"),
    )


def first_line(path: str, chunk_bytes: int = FIRST_BYTES) -> str:
    """The first line of a file, without its end; reads up to the chunk that holds the line break and no further."""
    held = []
    for data in chunks(path, 0, chunk_bytes):
        line, end, _ = data.partition(b"\n")
        held.append(line)
        if end:
            break
    return b"".join(held).decode("utf-8", "replace").removesuffix("\r")


def _first_lines(chunk_bytes: int):
    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([first_line(f, chunk_bytes) for f in batch.column("file").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("file"), lines], names=["file", "_line"])

    return first_lines


def first_record_per_file(spark: SparkSession, path: str, schema: T.StructType, chunk_bytes: int = FIRST_BYTES) -> DataFrame:
    """The first line of each file as ``(file, fields...)``; a file whose first line is no JSON object is skipped.

    Files are listed and dealt out in bunches; of each as much is read as its first line needs, whatever its size.
    """
    files = settle(list_files(spark, path).filter("size > 0").select("file"), "files")
    bunches = max(1, -(-files.count() // FILES_PER_TASK))
    first = files.repartitionByRange(bunches, "file").mapInArrow(_first_lines(chunk_bytes), "file string, _line string")
    first = first.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = first.withColumn("_json", F.from_json("_line", marked, {"columnNameOfCorruptRecord": CORRUPT}))
    good = parsed.filter(F.col("_json").isNotNull() & F.col(f"_json.{CORRUPT}").isNull())
    return good.select("file", *[F.col("_json")[n].alias(n) for n in schema.names])


def read_selected_file(spark: SparkSession, selected: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """All lines of the one file that ``selected`` names in its column ``file``; no other file is listed or read. No row: no lines."""
    row = selected.select("file").first()
    if row is None:
        return spark.createDataFrame([], schema)
    return _json(spark, GLOB.sub(r"\\\g<0>", row["file"]), schema, strict, {})


def read_pair_dataset(
    spark: SparkSession, root: str, lang: str, partition: str, pruning_types: Sequence[str], schema: T.StructType = PAIR_SET
) -> DataFrame:
    """Stored pair sets of some pruning types; the filters prune partition directories."""
    rows = spark.read.schema(schema).parquet(root)
    return rows.filter(
        (F.col("lang") == lang) & (F.col("partition") == partition) & F.col("pruning_type").isin(list(pruning_types))
    )


def read_partitioned_jsonl(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Back from ``write_jsonl``; filters on ``lang`` and ``partition`` prune directories."""
    return spark.read.schema(schema).json(root)


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below ``root``; only the listing is read, not the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(decoded_uri(F.col("path")).alias("path"))
