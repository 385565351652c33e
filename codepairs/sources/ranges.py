"""Records of large files, cut by many tasks.

A file whose line breaks or commas may lie inside quotes cannot be cut by looking
at one place of it. Here it is cut into byte ranges. A first pass runs a small
automaton over every range from each state it could begin in; the ranges' outcomes are
composed in order, which gives the true state at every range's start. A second
pass cuts the records: a range has those that open in it, and reads on past its
end until the last of them closes. No text is shuffled, no file is held whole,
and the result does not depend on where the ranges end.

Files are listed by Spark and read by byte range through ``pyarrow.fs``. A file
whose name says that it is compressed is one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.session import settle

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".br")

RANGES = "file string, no long, start long, stop long, size long"


class CsvAutomaton:
    """Quoting of comma-separated values with doubled quotes.

    States: 0 at the start of a field, 1 in an unquoted field, 2 in quotes, 3 behind a
    quote that closes them unless another one follows. A field is quoted only if a quote is its first
    character; what follows closing quotes is read up to the next separator.
    """

    states = 4
    begin = (0, 0)
    _run, _field = re.compile(b'"+'), re.compile(b'[,\n]"')

    def __init__(self, kind: str = ""):
        pass

    def kind(self, head: bytes) -> str:
        return "lines"

    def opens(self) -> bool:
        """Whether a record opens where the file begins."""
        return True

    @staticmethod
    def empty(record: bytes) -> bool:
        """An empty line, or what is behind the last line break."""
        return not record

    def _quoted(self, data: bytes, state: int) -> tuple[list[tuple[int, int]], int]:
        """The quoted stretches, and the state behind the data."""
        spans, at, end = [], 0, len(data)
        quoted = state == 2
        if end and state == 3:
            run = self._run.match(data)
            at = run.end() if run else 0
            quoted = at % 2 == 1
            if at == end:
                return spans, 2 if quoted else 3
        elif state == 0 and data[:1] == b'"':
            at, quoted = 1, True
        elif not end:
            return spans, state
        while True:
            if quoted:
                start, run = at, self._run.search(data, at)
                while run and (run.end() - run.start()) % 2 == 0:
                    run = self._run.search(data, run.end())
                spans.append((start, run.end() if run else end))
                if run is None:
                    return spans, 2
                at, quoted = run.end(), False
                if at == end:
                    return spans, 3
            field = self._field.search(data, at)
            if field is None:
                return spans, 0 if data[-1] in b",\n" else 1
            at, quoted = field.end(), True

    def outcomes(self, data: bytes) -> list[tuple[int, int]]:
        return [(self._quoted(data, state)[1], 0) for state in range(self.states)]

    def separators(self, data: bytes, state: tuple[int, int]) -> tuple[list[tuple[int, bool, bool]], tuple[int, int]]:
        """``(place, closes, opens)`` of what parts records, and the state behind the data."""
        spans, after = self._quoted(data, state[0])
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        if spans:
            starts, ends = np.array(spans).T
            before = np.searchsorted(starts, breaks, side="right") - 1
            breaks = breaks[(before < 0) | (breaks >= ends[np.maximum(before, 0)])]
        return [(place, True, True) for place in breaks.tolist()], (after, 0)


# What brackets add to the depth, and the bytes that count outside strings.
DEPTH = np.zeros(256, dtype=np.int64)
DEPTH[[91, 123]], DEPTH[[93, 125]] = 1, -1
MARKS = DEPTH != 0
MARKS[44] = True


class JsonAutomaton:
    """Strings and nesting of JSON: the elements of a top-level array, or the one object of a file.

    States: 0 outside strings, 1 inside, 2 inside and behind a backslash that
    escapes; with them goes the depth, to which a range adds the same from wherever it begins.
    """

    states = 3
    begin = (0, 0)

    def __init__(self, kind: str = "array"):
        self.array = kind == "array"

    def kind(self, head: bytes) -> str:
        return "array" if head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[" else "object"

    def opens(self) -> bool:
        return not self.array

    @staticmethod
    def empty(record: bytes) -> bool:
        """What an empty array holds, or a file of white space."""
        return not record.strip(b" \t\r\n")

    def _scan(self, data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Structural places and their bytes, how many quotes stand before each, and whether the data end in an open escape; then the quotes."""
        text = np.frombuffer(data, dtype=np.uint8)
        slashes = np.flatnonzero(text == 92)
        if escaped and len(slashes) and slashes[0] == 0:
            slashes = slashes[1:]
        # Of a run of backslashes every other one escapes what follows.
        first = np.concatenate(([True], np.diff(slashes) != 1)) if len(slashes) else np.zeros(0, dtype=bool)
        starts = slashes[first][np.cumsum(first) - 1] if len(slashes) else slashes
        escapes = slashes[(slashes - starts) % 2 == 0]
        quotes = np.flatnonzero(text == 34)
        after = np.zeros(len(text) + 1, dtype=bool)
        after[escapes + 1] = True
        hidden = after[quotes]
        if escaped and len(quotes) and quotes[0] == 0:
            hidden[0] = True
        quotes = quotes[~hidden]
        marks = np.flatnonzero(MARKS[text])
        open_end = bool(len(escapes) and escapes[-1] == len(text) - 1)
        return marks, text[marks], quotes, open_end

    def _state(self, state: int, quotes: np.ndarray, open_end: bool) -> int:
        inside = (len(quotes) + (state > 0)) % 2
        return 2 if inside and open_end else int(inside)

    def outcomes(self, data: bytes) -> list[tuple[int, int]]:
        if not data:
            return [(state, 0) for state in range(self.states)]
        out = []
        usual = self._scan(data, False)
        # An open escape changes nothing but a quote or a backslash that comes first.
        escaped = self._scan(data, True) if data[0] in b'"\\' else usual
        for state in range(self.states):
            marks, kinds, quotes, open_end = escaped if state == 2 else usual
            outside = (np.searchsorted(quotes, marks) + (state > 0)) % 2 == 0
            out.append((self._state(state, quotes, open_end), int(DEPTH[kinds[outside]].sum())))
        return out

    def separators(self, data: bytes, state: tuple[int, int]) -> tuple[list[tuple[int, bool, bool]], tuple[int, int]]:
        if not data:
            return [], state
        marks, kinds, quotes, open_end = self._scan(data, state[0] == 2)
        outside = (np.searchsorted(quotes, marks) + (state[0] > 0)) % 2 == 0
        marks, kinds = marks[outside], kinds[outside]
        after = state[1] + np.cumsum(DEPTH[kinds])
        depth = int(after[-1]) if len(after) else state[1]
        found = []
        if self.array:
            closes = ((kinds == 44) & (after == 1)) | ((kinds == 93) & (after == 0))
            opens = ((kinds == 44) & (after == 1)) | ((kinds == 91) & (after == 1))
            hit = np.flatnonzero(closes | opens)
            found = list(zip(marks[hit].tolist(), closes[hit].tolist(), opens[hit].tolist(), strict=True))
        return found, (self._state(state[0], quotes, open_end), depth)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a listed path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def chunks(path: str, start: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of a file from ``start`` on, as much at a time as asked for and no more; a compressed file is read from its start."""
    system, name = opened(path)
    if path.endswith(COMPRESSED):
        with system.open_input_stream(name) as stream:
            while data := stream.read(chunk_bytes):
                yield data
        return
    with system.open_input_file(name) as file:
        file.seek(start)
        while data := file.read(chunk_bytes):
            yield data


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, size``; files are listed, not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"))


def byte_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The files below ``path`` in ranges of ``split_bytes``, numbered in each file."""
    whole = F.lit(False)
    for ending in COMPRESSED:
        whole = whole | F.col("file").endswith(ending)
    files = list_files(spark, path).withColumn("_n", F.when(whole, 1).otherwise(F.ceil(F.col("size") / split_bytes)))
    ranges = files.filter("size > 0").select("file", "size", whole.alias("_whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).alias("no"))
    stop = F.when(F.col("_whole"), F.lit(1 << 62)).otherwise(F.least("size", (F.col("no") + 1) * split_bytes))
    return settle(ranges.select("file", "no", (F.col("no") * split_bytes).alias("start"), stop.alias("stop"), "size"), "ranges")


def _dealt(ranges: DataFrame) -> DataFrame:
    """A task per range."""
    return ranges.repartitionByRange(max(1, ranges.count()), "file", "no")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _told(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _outcomes(automaton_type: type, chunk_bytes: int):
    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a range does to each state: the state it ends in, and the depth that it adds."""
        automaton = automaton_type()
        for row in _rows(batches):
            ends, left, kind = [(s, 0) for s in range(automaton.states)], row["stop"] - row["start"], None
            for data in chunks(row["file"], row["start"], chunk_bytes):
                data = data[:left]
                left -= len(data)
                # White space alone does not tell what a file holds.
                if kind is None and row["no"] == 0 and data.strip(b"\xef\xbb\xbf \t\r\n"):
                    kind = automaton.kind(data)
                step = automaton.outcomes(data)
                ends = [(step[s][0], depth + step[s][1]) for s, depth in ends]
                if not left:
                    break
            state, depth = ([e[i] for e in ends] for i in range(2))
            names = ["file", "no", "start", "stop", "size", "states", "depths", "kind"]
            kinds = (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            yield _told([(*(row[n] for n in names[:5]), state, depth, kind)], names, kinds)

    return outcomes


def _compose(automaton_type: type):
    def compose(group: pa.Table) -> pa.Table:
        """The ranges of a file in order, each with the state and depth that it begins in, and those behind the last."""
        rows = sorted(group.to_pylist(), key=lambda r: r["no"])
        state, depth = automaton_type.begin
        kind = next((r["kind"] for r in rows if r["kind"]), "object")
        out = []
        for row in rows:
            out.append((row["file"], row["no"], row["start"], row["stop"], row["size"], state, depth, kind))
            state, depth = row["states"][state], depth + row["depths"][state]
        names = ["file", "no", "start", "stop", "size", "state", "depth", "kind"]
        batch = _told(out, names, (pa.string(), *[pa.int64()] * 6, pa.string()))
        return pa.Table.from_batches([batch]).append_column("last_state", pa.array([state] * len(out), pa.int64())).append_column("last_depth", pa.array([depth] * len(out), pa.int64()))

    return compose


def cut(path: str, start: int, stop: int, automaton, state: tuple[int, int], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """``(place, record)`` of the records that open from ``start`` to before ``stop``."""
    held: list[bytes] | None = [] if start == 0 and automaton.opens() else None
    opened_at, at = 0, start
    for data in chunks(path, start, chunk_bytes):
        before = 0
        found, state = automaton.separators(data, state)
        for place, closes, opens in found:
            if held is not None and closes:
                yield opened_at, b"".join([*held, data[before:place]])
                held = None
            if at + place >= stop and held is None:
                return
            if opens:
                held, opened_at, before = [], at + place + 1, place + 1
        at += len(data)
        if held is not None:
            held.append(data[before:])
        elif at >= stop:
            return
    if held is not None:
        yield opened_at, b"".join(held)


def _records(automaton_type: type, chunk_bytes: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["file", "at", "record"], (pa.string(), pa.int64(), pa.string())
        for row in _rows(batches):
            rows: list[tuple] = []
            held = 0
            for at, record in cut(row["file"], row["start"], row["stop"], automaton_type(row["kind"]), (row["state"], row["depth"]), chunk_bytes):
                if automaton_type.empty(record):
                    continue
                rows.append((row["file"], at, record.decode("utf-8", "replace")))
                held += len(record)
                if held > CHUNK_BYTES:
                    yield _told(rows, names, kinds)
                    rows, held = [], 0
            yield _told(rows, names, kinds)

    return records


def ranged_records(
    spark: SparkSession, path: str, automaton_type: type, split_bytes: int = SPLIT_BYTES, balanced: bool = False, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``file, at, record``: the records of all files below ``path``, each with its place in bytes.

    With ``balanced`` a file that ends inside a string or a bracket is an error.
    """
    ranges = byte_ranges(spark, path, split_bytes)
    schema = f"{RANGES}, states array<long>, depths array<long>, kind string"
    outcomes = settle(_dealt(ranges).mapInArrow(_outcomes(automaton_type, chunk_bytes), schema), "range-outcomes")
    # A row per range: a file of a terabyte has some ten thousand.
    placed = outcomes.groupBy("file").applyInArrow(_compose(automaton_type), f"{RANGES}, state long, depth long, kind string, last_state long, last_depth long")
    if balanced:
        bad = (F.col("last_state") != 0) | (F.col("last_depth") != 0)
        placed = placed.withColumn("file", F.when(bad, F.raise_error(F.concat(F.lit("brackets or quotes left open: "), "file"))).otherwise(F.col("file")))
    placed = settle(placed.drop("last_state", "last_depth"), "range-states")
    return _dealt(placed).mapInArrow(_records(automaton_type, chunk_bytes), "file string, at long, record string")
