"""Encoding texts beyond a model's length: overlapping windows, encoded evenly, stitched by position.

A text's tokens are cut into windows that overlap. Windows are rows, dealt out by a
digest, so one long text is spread over tasks. Each window's vectors are kept where they have most context
on both sides: half an overlap is given up at either end, but not at the ends of the text.
The result is a row per token. Where these are only pooled, runs of windows are dealt out instead, and a row of
sums and maxima per run leaves the encoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepairs.functions.text import TOKEN
from codepairs.operators.vectors import TOKEN_RUN, pool_parts

# Windows encoded at once, and runs told at once.
BATCH_ROWS = 32
RUNS_TOLD = 256
# What stands between the tokens of a window on their way to the encoder: white space, which no token holds.
BETWEEN = "\n"


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


class _Windows:
    """The windows of rows with ``_tokens``, of which there are ``_n``, as columns of a window's number."""

    def __init__(self, window: int, overlap: int):
        if not 0 <= overlap < window:
            raise ValueError("an overlap is shorter than a window")
        self.window, self.step, self.half = window, window - overlap, overlap // 2
        self.n = F.col("_n").cast("long")
        # The last window is the one that reaches the end.
        self.last = F.greatest(F.ceil((F.col("_n") - window) / self.step), F.lit(0)).cast("long")

    def keep_from(self, number: Column) -> Column:
        return F.when(number == 0, F.lit(0).cast("long")).otherwise(number * self.step + self.half)

    def keep_to(self, number: Column) -> Column:
        return F.when(number == self.last, self.n).otherwise(number * self.step + self.step + self.half)

    def tokens(self, number: Column) -> Column:
        return F.slice("_tokens", (number * self.step + 1).cast("int"), F.lit(self.window))

    def of(self, position: Column) -> Column:
        """The number of the window that answers for a position."""
        number = F.floor((position - self.half) / F.lit(self.step)).cast("long")
        return F.least(F.greatest(number, F.lit(0).cast("long")), self.last)


def _with_tokens(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    return df.select(F.col(id_col), tokens.alias("_tokens")).withColumn("_n", F.size("_tokens")).filter("_n > 0")


def token_windows(df: DataFrame, id_col: str, tokens: Column, window: int, overlap: int) -> DataFrame:
    """``id, window, start, keep_from, keep_to, tokens``: windows of ``window`` tokens that share ``overlap`` with the next.

    ``keep_from`` to before ``keep_to`` are the positions that a window answers for; every position of a text has one window. A text without tokens has none.
    """
    w = _Windows(window, overlap)
    cut = _with_tokens(df, id_col, tokens).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), w.last)))
    number = F.col("window")
    return cut.select(
        id_col,
        "window",
        (number * w.step).alias("start"),
        w.keep_from(number).alias("keep_from"),
        w.keep_to(number).alias("keep_to"),
        w.tokens(number).alias("tokens"),
    )


def token_runs(df: DataFrame, id_col: str, tokens: Column, window: int, overlap: int, run: int) -> DataFrame:
    """``id, run, windows``: the windows, in order, that answer for positions from ``run`` times the run's length on, and which of these each answers for.

    A window is ``start, keep_from, keep_to, tokens``, as in ``token_windows``, its tokens one string: an array of short strings is several
    times as large. Of a window between two runs, each has its part.
    """
    w = _Windows(window, overlap)
    runs = F.sequence(F.lit(0).cast("long"), F.floor((w.n - 1) / F.lit(run)).cast("long"))
    cut = _with_tokens(df, id_col, tokens).withColumn("run", F.explode(runs))
    begin, end = F.col("run") * run, F.least(F.col("run") * run + run, w.n)

    def told(number: Column) -> Column:
        return F.struct(
            (number * w.step).alias("start"),
            F.greatest(w.keep_from(number), begin).alias("keep_from"),
            F.least(w.keep_to(number), end).alias("keep_to"),
            F.array_join(w.tokens(number), BETWEEN).alias("tokens"),
        )

    return cut.select(id_col, "run", F.transform(F.sequence(w.of(begin), w.of(end - 1)), told).alias("windows"))


def hashed_context_encoder(dim: int = 8, reach: int = 2) -> Callable:
    """Default encoder: a token's vector adds up the digests of the tokens at most ``reach`` away from it."""

    def make() -> Callable:
        import hashlib
        from functools import lru_cache

        @lru_cache(maxsize=100_000)
        def row(token: str) -> np.ndarray:
            return (np.frombuffer(hashlib.md5(token.encode()).digest()[:dim], dtype=np.uint8) - 127.5) / 127.5

        def encode(windows: list[list[str]]) -> list[np.ndarray]:
            out = []
            for tokens in windows:
                rows = np.stack([row(t) for t in tokens])
                total = np.zeros_like(rows)
                for away in range(-reach, reach + 1):
                    low, high = max(0, away), min(len(rows), len(rows) + away)
                    if low < high:
                        total[low - away : high - away] += rows[low:high]
                out.append(total)
            return out

        return encode

    return make


def _kept(encode: Callable, windows: pa.StructArray | pa.RecordBatch, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From where to where each window answers, and its vectors there."""
    matrices = [np.asarray(m, dtype=np.float64) for m in encode(tokens)]
    start, low, high = (windows.field(c).to_numpy(zero_copy_only=False) for c in ("start", "keep_from", "keep_to"))
    kept = [m[a - s : b - s] for m, s, a, b in zip(matrices, start, low, high, strict=True)]
    if any(len(m) != b - a for m, a, b in zip(kept, low, high, strict=True)):
        raise ValueError("an encoder gives a vector per token")
    return low, high, kept


def _encode(load: Callable, id_col: str, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.slice(at, batch_rows)
                low, high, kept = _kept(encode, part.to_struct_array(), part.column("tokens").to_pylist())
                rows = np.repeat(np.arange(len(part)), high - low)
                positions = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                ends = np.concatenate(([0], np.cumsum(np.repeat([m.shape[1] for m in kept], high - low)))).astype(np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([m.ravel() for m in kept])))
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(rows)), pa.array(positions), vectors], names=[id_col, "pos", "vec"])

    return run


RUN_FOLDS = {"sum": np.add, "max": np.maximum}
RUN_ROWS = "run long, last long, last_vec array<double>, cls array<double>, n_all long, sum_all array<double>, max_all array<double>, sum_cut array<double>, max_cut array<double>"


def _run_row(first: int, vectors: np.ndarray) -> tuple:
    """Of a run's vectors the last position and vector, the text's first vector, and of the others number, sums and maxima, then without the last."""
    body = vectors[1:] if first == 0 else vectors
    # One after another, so that sums do not depend on how windows cut the run.
    folds = [fold.accumulate(body, axis=0) for fold in RUN_FOLDS.values()]
    whole, cut = ([f[-back] if len(f) >= back else None for f in folds] for back in (1, 2))
    return first + len(vectors) - 1, vectors[-1], vectors[0] if first == 0 else None, len(body), *whole, *cut


def _encode_runs(load: Callable, id_col: str, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        vec, long = pa.list_(pa.float64()), pa.int64()
        kinds = (long, vec, vec, long, vec, vec, vec, vec)
        names = [id_col, *(c.split()[0] for c in RUN_ROWS.split(", "))]

        def told(of: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([of.column(id_col), of.column("run"), *columns], names=names)

        for batch in batches:
            windows = batch.column("windows")
            flat, ends = windows.flatten(), set(np.cumsum(windows.value_lengths().to_numpy()).tolist())
            rows: list[tuple] = []
            held: list[np.ndarray] = []
            first, done = None, 0
            # No more is held than the vectors of one run and of one call.
            for at in range(0, len(flat), batch_rows):
                part = flat.slice(at, batch_rows)
                low, _, kept = _kept(encode, part, [t.split(BETWEEN) for t in part.field("tokens").to_pylist()])
                for number, (position, vectors) in enumerate(zip(low.tolist(), kept, strict=True), at + 1):
                    first = position if first is None else first
                    held.append(vectors)
                    if number in ends:
                        rows.append(_run_row(first, np.concatenate(held)))
                        first, held = None, []
                if len(rows) >= RUNS_TOLD:
                    yield told(batch.slice(done, len(rows)), rows)
                    done, rows = done + len(rows), []
            if rows:
                yield told(batch.slice(done, len(rows)), rows)

    return run


def embed_long(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    make_fn: Callable | None = None,
    window: int = 512,
    overlap: int = 64,
    tasks: int | None = None,
    batch_rows: int = BATCH_ROWS,
    run: int | None = None,
) -> DataFrame:
    """``id, pos, vec``: one row per token of every text, whatever its length.

    ``make_fn`` loads the encoder once per task; it maps a list of token lists, of ``window`` tokens at most, to a list of matrices with a row
    per token. Where a token's vector depends only on tokens up to ``overlap // 2`` away, the result equals that of the whole text. Null and empty texts have no rows.

    With ``run``, a row per run of so many tokens instead, with the sums and maxima of their vectors, which ``pool_parts`` merges: where
    vectors are only pooled, none is shuffled. A run's windows are encoded by one task.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType.simpleString()
    make_fn, tokens = make_fn or hashed_context_encoder(), text_tokens(F.col(text_col))
    if run is not None:
        dealt = token_runs(df, id_col, tokens, window, overlap, run).repartition(tasks, F.xxhash64(id_col, "run"))
        return dealt.mapInArrow(_encode_runs(make_fn, id_col, batch_rows), f"`{id_col}` {kind}, {RUN_ROWS}")
    dealt = token_windows(df, id_col, tokens, window, overlap).repartition(tasks, F.xxhash64(id_col, "window"))
    return dealt.mapInArrow(_encode(make_fn, id_col, batch_rows), f"`{id_col}` {kind}, pos long, vec array<double>")


def embed_long_pooled(df: DataFrame, id_col: str, text_col: str = "text", make_fn: Callable | None = None, window: int = 512, overlap: int = 64) -> DataFrame:
    """``id, cls, max, mean`` of every text's token vectors."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = embed_long(texts, "_id", "_text", make_fn, window, overlap, run=TOKEN_RUN)
    # Of texts that share an id, the last token is that of the largest position, then vector.
    part = F.struct("run", "last", "last_vec", "cls", "n_all", "sum_all", "max_all", "sum_cut", "max_cut")
    return pool_parts(rows.select(F.col("_id").alias(id_col), part.alias("_part")), id_col)
