"""Plain trees of JSON Lines as a data source: ``root/value/.../value.jsonl``.

Directory and file names are columns. Filters on them are pushed to the reader,
which lists only directories that can match and opens only files that do; files are cut
into byte ranges, and small ones share a task.

A write is one job for all directories. Tasks write parts below a hidden folder
and report them; the commit moves the parts of the successful attempts to
``.../value.jsonl/part-*``, publishes one manifest with their rows and bytes (of lines, compressed or not), and
drops the hidden folder, with whatever a failed or repeated attempt left there. An
aborted write leaves nothing. Where there is a manifest, only its files are read.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from codepairs.functions.text import backticked
from codepairs.sources.ranges import CHUNK_BYTES, COMPRESSED, SPLIT_BYTES, cut, opened

FORMAT = "jsonl_tree"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
MANIFEST = "_manifest.json"
# The directory that stands for null, as in Hive's layout.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
ENDING = ".jsonl"
# Files that a task holds open.
OPEN_FILES = 64
# Ending of compressed parts, and how hard these are compressed.
GZIP, GZIP_LEVEL = ".gz", 1


def to_name(value: str | None) -> str:
    """A value as the name of a directory or file: as it is, but for what a path cannot hold and what hides it."""
    if value is None:
        return NULL_NAME
    name = "".join(quote(c, safe="") if c in '/\\%:*?"<>|' or ord(c) < 32 else c for c in value)
    return name if name and name[0] not in "._" else "%" + format(ord(name[0]), "02X") + name[1:] if name else "%00"


def from_name(name: str) -> str | None:
    return None if name == NULL_NAME else "" if name == "%00" else unquote(name)


def _test(f: Filter) -> tuple[str, Callable[[str | None], bool]] | None:
    """The column of a filter and its test of a name, or None for one that names cannot answer."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # A null is neither in a condition nor in its opposite.
        return None if inner is None or isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)) else (inner[0], lambda v: v is not None and not inner[1](v))
    tests = {
        EqualTo: lambda v: v is not None and v == f.value,
        EqualNullSafe: lambda v: v == f.value,
        In: lambda v: v is not None and v in f.value,
        IsNull: lambda v: v is None,
        IsNotNull: lambda v: v is not None,
        StringStartsWith: lambda v: v is not None and v.startswith(f.value),
        StringEndsWith: lambda v: v is not None and v.endswith(f.value),
        StringContains: lambda v: v is not None and f.value in v,
    }
    found = tests.get(type(f))
    if found is None or len(f.attribute) != 1 or (isinstance(f, In) and None in f.value):
        return None
    return f.attribute[0], found


@dataclass
class Piece:
    file: str
    start: int
    stop: int
    values: tuple[str | None, ...]


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(self.pieces)


class LineAutomaton:
    begin = (0, 0)

    def opens(self) -> bool:
        return True

    def separators(self, data: bytes, state: tuple[int, int]) -> tuple[list[tuple[int, bool, bool]], tuple[int, int]]:
        return [(i, True, True) for i in np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10).tolist()], state


class TreeReader(DataSourceReader):
    def __init__(self, root: str, columns: Sequence[str], split_bytes: int):
        self.root, self.columns, self.split_bytes = root.rstrip("/"), list(columns), split_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f)
            if test is not None and test[0] in self.columns:
                self.filters.append(f)
            else:
                yield f

    def _fits(self, column: str, value: str | None) -> bool:
        tests = [t for t in map(_test, self.filters) if t is not None]
        return all(test(value) for name, test in tests if name == column)

    def _listed(self) -> Iterator[tuple[str, int, tuple[str | None, ...]]]:
        """``file, size, values`` of what matches; a directory that cannot match is not listed."""
        system, root = opened(self.root)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as stream:
                known = json.loads(stream.read())["files"]
            for entry in known:
                if all(self._fits(c, v) for c, v in zip(self.columns, entry["values"], strict=True)):
                    yield f"{self.root}/{entry['path']}", entry["bytes"], tuple(entry["values"])
            return
        todo: list[tuple[str, tuple[str | None, ...]]] = [("", ())]
        while todo:
            folder, values = todo.pop()
            column = self.columns[len(values)]
            last = len(values) == len(self.columns) - 1
            for entry in sorted(system.get_file_info(fs.FileSelector(root + folder)), key=lambda e: e.path):
                name = entry.base_name
                if name[0] in "._":
                    continue
                is_folder = entry.type == fs.FileType.Directory
                at = f"{folder}/{name}"
                if last:
                    stem = name.split(".", 1)[0]
                    if not (name.endswith(ENDING) or name.endswith(tuple(ENDING + c for c in COMPRESSED))) or not self._fits(column, from_name(stem)):
                        continue
                    told = (*values, from_name(stem))
                    if is_folder:
                        parts = system.get_file_info(fs.FileSelector(root + at))
                        yield from ((f"{self.root}{at}/{p.base_name}", p.size, told) for p in parts if p.base_name[0] not in "._")
                    else:
                        yield f"{self.root}{at}", entry.size, told
                elif is_folder and self._fits(column, from_name(name)):
                    todo.append((at, (*values, from_name(name))))

    def partitions(self) -> Sequence[InputPartition]:
        bunches, held, size = [], [], 0
        for file, total, values in sorted(self._listed(), key=lambda f: f[0]):
            if file.endswith(COMPRESSED):
                cuts = [(0, 1 << 62)]
            else:
                cuts = [(s, min(total, s + self.split_bytes)) for s in range(0, total, self.split_bytes)]
            for start, stop in cuts:
                length = min(stop, max(total, 1)) - start
                if held and size + length > self.split_bytes:
                    bunches.append(Pieces(held))
                    held, size = [], 0
                held.append(Piece(file, start, stop, values))
                size += length
        # A plan without any task would have no schema to tell.
        return [*bunches, Pieces(held)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        names = [*self.columns, "file", "line"]

        def told(piece: Piece, lines: list[str]) -> pa.RecordBatch:
            same = [pa.array([v] * len(lines), pa.string()) for v in (*piece.values, piece.file)]
            return pa.RecordBatch.from_arrays([*same, pa.array(lines, pa.string())], names=names)

        for piece in partition.pieces:
            lines, size = [], 0
            for _, line in cut(piece.file, piece.start, piece.stop, LineAutomaton(), (0, 0)):
                if line.strip():
                    lines.append(line.decode("utf-8", "replace"))
                    size += len(line)
                if size > CHUNK_BYTES:
                    yield told(piece, lines)
                    lines, size = [], 0
            yield told(piece, lines)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``CHUNK_BYTES``, as their lines are copied several times on their way."""
    for batch in batches:
        step = max(1, len(batch) * CHUNK_BYTES // max(batch.nbytes, 1))
        yield from (batch.slice(at, step) for at in range(0, len(batch), step))


class Part:
    """A file of lines that is being written, compressed by ``gzip`` if its name says so."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_output_stream(path, compression=None)
        self.to = gzip.GzipFile(filename="", fileobj=self.file, mode="wb", compresslevel=GZIP_LEVEL, mtime=0) if path.endswith(GZIP) else self.file

    def write(self, data: bytes) -> None:
        self.to.write(data)

    def close(self) -> None:
        try:
            self.to.close()
        finally:
            self.file.close()


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, columns: Sequence[str], leaf: str | None, overwrite: bool, gzipped: bool = False):
        self.root, self.columns, self.leaf, self.overwrite = root.rstrip("/"), list(columns), leaf, overwrite
        self.ending = ".json" + (GZIP if gzipped else "")
        self.hidden = f"_parts-{uuid.uuid4().hex}"

    def _folder(self, values: tuple[str | None, ...]) -> str:
        names = [to_name(v) for v in values] + ([self.leaf] if self.leaf else [])
        return "/".join(names) + ENDING

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.root)
        attempt = uuid.uuid4().hex
        files: list[dict] = []
        streams: dict[tuple, tuple[dict, Part]] = {}
        try:
            for batch in _in_chunks(iterator):
                rows: dict[tuple, list[str]] = {}
                keys = zip(*[batch.column(c).to_pylist() for c in self.columns], strict=True)
                for key, line in zip(keys, batch.column("line").to_pylist(), strict=True):
                    rows.setdefault(key, []).append(line)
                for key, lines in rows.items():
                    if key not in streams:
                        if len(streams) >= OPEN_FILES:
                            streams.pop(next(iter(streams)))[1].close()
                        path = f"{self._folder(key)}/part-{attempt}-{len(files)}{self.ending}"
                        system.create_dir(f"{root}/{self.hidden}/{self._folder(key)}", recursive=True)
                        files.append({"path": path, "rows": 0, "bytes": 0, "values": list(key)})
                        streams[key] = (files[-1], Part(system, f"{root}/{self.hidden}/{path}"))
                    entry, stream = streams[key]
                    data = ("\n".join(lines) + "\n").encode()
                    stream.write(data)
                    entry["rows"] += len(lines)
                    entry["bytes"] += len(data)
                    if entry["bytes"] >= SPLIT_BYTES and self.ending.endswith(GZIP):
                        # No task can read a part of it.
                        streams.pop(key)[1].close()
        finally:
            for _, stream in streams.values():
                stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["path"])
        manifest = f"{root}/{MANIFEST}"
        before: list[dict] = []
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as stream:
                before = json.loads(stream.read())["files"]
        for entry in files:
            folder, _ = entry["path"].rsplit("/", 1)
            system.create_dir(f"{root}/{folder}", recursive=True)
            system.move(f"{root}/{self.hidden}/{entry['path']}", f"{root}/{entry['path']}")
        kept = [] if self.overwrite else before
        system.create_dir(f"{root}/{self.hidden}", recursive=True)
        with system.open_output_stream(f"{root}/{self.hidden}/{MANIFEST}") as stream:
            stream.write(json.dumps({"columns": self.columns, "files": kept + files}).encode())
        # From here on readers see the new files, and only those.
        system.move(f"{root}/{self.hidden}/{MANIFEST}", manifest)
        for entry in before if self.overwrite else []:
            system.delete_file(f"{root}/{entry['path']}")
        system.delete_dir(f"{root}/{self.hidden}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        if system.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.hidden}")


class JsonlTree(DataSource):
    """Options: ``path``; ``columns``, the names of the levels as a JSON list; ``leaf``, ``split_bytes`` and ``gzipped``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> list[str]:
        return json.loads(self.options["columns"])

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in (*self._columns(), "file", "line")])

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options["path"], self._columns(), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self._columns(), self.options.get("leaf"), overwrite, self.options.get("gzipped") == "true")


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set(PUSHDOWN, "true")  # without it a reader with filters is an error
    spark.dataSource.register(JsonlTree)
    return spark


def read_jsonl_tree(
    spark: SparkSession, root: str, schema: T.StructType, columns: Sequence[str] = ("lang", "partition"), strict: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The fields of ``schema`` and the path columns of ``root/{columns[0]}/.../{columns[-1]}.jsonl``, each a file or a directory of parts.

    Filters on path columns are pushed down: nothing else is listed or opened. A file name counts up to its first dot. Strict
    reads fail on a bad line; others keep it in ``_corrupt_record``. Sets the session's switch for such filters.
    """
    options = {"path": root, "columns": json.dumps(list(columns)), "split_bytes": str(split_bytes)}
    lines = _registered(spark).read.format(FORMAT).options(**options).load()
    if strict:
        wide, how = schema, {"mode": "FAILFAST"}
    else:
        wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select(*[backticked(c) for c in columns], F.from_json("line", wide, how).alias("_json"))
    return parsed.select(*[F.col("_json")[n].alias(n) for n in wide.names], *[backticked(c) for c in columns])


def write_jsonl_files(
    df: DataFrame, root: str, by: Sequence[str] = ("lang", "partition"), leaf: str | None = None, mode: str = "errorifexists", gzipped: bool = False
) -> None:
    """``root/{by[0]}/.../{by[-1]}.jsonl`` or, with ``leaf``, ``root/{by[0]}/.../{by[-1]}/{leaf}.jsonl``, in one job.

    Values become names as text, null among them; names need not be known before. Non-ASCII is kept, nulls are written.
    ``gzipped`` parts take a third of the disk or less; none holds much more than ``SPLIT_BYTES`` of lines, as one task has to read it.
    """
    _registered(df.sparkSession)
    system, name = opened(root)
    there = system.get_file_info(f"{name}/{MANIFEST}").type == fs.FileType.File
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    if there and mode == "errorifexists":
        raise FileExistsError(root)
    rest = [backticked(c) for c in df.columns if c not in by]
    named = [backticked(c).cast("string").alias(c) for c in by]
    lines = df.select(*named, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("line"))
    options = {"path": root, "columns": json.dumps(list(by)), "gzipped": str(gzipped).lower()} | ({"leaf": leaf} if leaf else {})
    lines = lines.hint("rebalance", *[backticked(c) for c in by])
    lines.write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").options(**options).save()


def tree_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Path columns, ``rows`` and ``bytes`` per directory of a written tree, as the write itself counted them; no data are read."""
    system, name = opened(root)
    with system.open_input_stream(f"{name}/{MANIFEST}") as stream:
        told = json.loads(stream.read())
    columns = told["columns"]
    files = [(*f["values"], f["rows"], f["bytes"]) for f in told["files"]]  # a row per part, as the commit had them
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())])
    rows = spark.createDataFrame(files, schema)
    return rows.groupBy(*[backticked(c) for c in columns]).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
