"""Packing into fixed windows by non-negative least squares.

Documents become token ids. What fills whole windows is cut off and is a
sequence at once; the rests, shorter than a window, are counted by length. All
combinations of at most three lengths that fill a window exactly are listed, and
non-negative least squares finds how often to repeat each so that their lengths
add up to the histogram. Repeats are rounded, and lowered where a length has run
out. Residual rests are packed greedily, longest first: each window is filled to
the brim, and the rest that crosses its end is cut there. The last window is cut
into powers of two, which need no padding.

The solver sees the histogram, which has as many entries as a window has tokens,
whatever the number of documents. Spark counts, ranks rests inside their length
(in salted buckets), looks up the place of a rank in the plan, and cuts.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.session import bounded_broadcast, settle

# The window, the id that ends a document, and how byte-level tokenizers split text before merging.
WINDOW = 1024
END_ID = 0
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Lengths of a combination at most; steps of the solver; least rows of a bucket of ranks.
DEPTH = 3
STEPS = 400
BUCKET_ROWS = 500
# Characters encoded before ids are passed on.
SLICE_CHARS = 1 << 22

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class ByteEncoder:
    """The ids of texts by a byte-level tokenizer file, as 32-bit numbers.

    Where the file's merges are numbered in their order, a faster library gives
    the same ids from ranks; otherwise, and for what it cannot take, the file's own library does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        added = {t["content"]: t["id"] for t in spec["added_tokens"] if not any(t[k] for k in ("single_word", "lstrip", "rstrip"))}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        ids = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in merges]
        if model["type"] != "BPE" or any(before.get(k) != v for k, v in plain.items()) or spec.get("normalizer") or spec.get("post_processor"):
            return None
        if model.get("dropout") or model.get("ignore_merges") or len(added) != len(spec["added_tokens"]) or ids != sorted(set(ids)) or (ids and ids[0] < 256):
            return None
        import tiktoken

        # The alphabet of byte-level files: printable bytes stand for themselves, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as failed:  # its patterns give up on very long runs by a panic, which is no Exception
                if isinstance(failed, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[str, ByteEncoder] = {}


def _cut(path: str, window: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, ByteEncoder(path))

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

        for batch in batches:
            rows: list[tuple] = []
            seen = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                data = ids.tobytes()
                rows += [(doc_id, s, min(window, len(ids) - s), data[4 * s : 4 * (s + window)], len(ids)) for s in range(0, len(ids), window)]
                seen += len(text)
                if seen > SLICE_CHARS:
                    yield told(rows)
                    rows, seen = [], 0
            yield told(rows)

    return cut


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """All choices, smallest first, of at most ``depth`` of the lengths (repeats allowed) that add up to ``window``; a row each, zeros in front."""
    lengths = np.sort(lengths)
    present = np.zeros(window + 1, dtype=bool)
    present[lengths] = True
    # Each step adds a length no smaller than the one before; the last is what is missing.
    parts = [np.zeros((1, 0), dtype=np.int64)]
    out = []
    for size in range(1, depth + 1):
        for part in parts:
            last = window - part.sum(axis=1)
            least = part[:, -1] if size > 1 else np.ones(len(part), dtype=np.int64)
            good = (last >= least) & (last > 0)
            good[good] = present[last[good]]
            found = np.column_stack([part[good], last[good]])
            out.append(np.column_stack([np.zeros((len(found), depth - size), dtype=np.int64), found]))
        if size < depth:
            longer = []
            for part in parts:
                for length in lengths.tolist():
                    # The rest must still hold one no smaller.
                    fits = (part.sum(axis=1) + 2 * length <= window) & ((part[:, -1] <= length) if part.shape[1] else True)
                    if fits.any():
                        longer.append(np.column_stack([part[fits], np.full(int(fits.sum()), length)]))
            parts = [np.concatenate(longer)] if longer else []
    return np.concatenate(out) if out else np.zeros((0, depth), dtype=np.int64)


def repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: how often to use each combination so that the lengths used come near ``histogram``.

    Accelerated projected gradients with restarts, on the counts divided by their
    greatest; the matrix is never built, since a column has as many entries as a combination has lengths.
    """
    window = len(histogram) - 1
    if not len(combos):
        return np.zeros(0)
    size = max(float(histogram[1:].max()), 1.0)
    target = histogram / size
    target[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, j], weights=x, minlength=window + 1) for j in range(combos.shape[1]))
        out[0] = 0.0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[combos[:, j]] for j in range(combos.shape[1]))

    # The greatest eigenvalue, by powers, with a margin.
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (1.05 * top)
    x = np.zeros(len(combos))
    y, pace = x.copy(), 1.0
    for _ in range(steps):
        ahead = np.maximum(y - rate * back(used(y) - target), 0.0)
        if ((y - ahead) * (ahead - x)).sum() > 0:
            pace, y = 1.0, x.copy()  # it went uphill: start again from the last point
            ahead = np.maximum(y - rate * back(used(y) - target), 0.0)
        after = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        y = ahead + (pace - 1) / after * (ahead - x)
        x, pace = ahead, after
    return x * size


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeats that use no length more often than there is: rounded down first, then raised by one where it fits, largest parts first."""
    left = histogram.astype(np.int64).copy()
    out = np.floor(x).astype(np.int64)
    order = np.lexsort((np.arange(len(x)), out - x))

    def take(i: int, many: int) -> int:
        """As many repeats of combination ``i`` as there are lengths left for, at most ``many``."""
        lengths, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        many = int(min(many, (left[lengths] // times).min()))
        left[lengths] -= many * times
        return many

    for i in np.flatnonzero(out).tolist():
        out[i] = take(i, int(out[i]))
    for i in order[: 4 * len(histogram)].tolist():
        if x[i] > 0:
            out[i] += take(i, 1)
    return out


@dataclass
class Plan:
    """Where a rest of some length and rank goes.

    Ranks of a length from ``first`` on, up to the next run of that length, go to sequences from
    ``sequence`` on, one each, at ``offset``. Ranks from ``used`` on are residual: one behind the other from ``begin`` in the
    stream that is cut at the window's multiples and, behind the last of these, at ``ends``; its sequences start at ``stream``.
    """

    window: int
    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    begin: np.ndarray
    ends: np.ndarray
    stream: int
    sequences: int

    def parts(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start in the rest, length, sequence, offset)`` of a rest."""
        if rank < self.used[length]:
            low, high = np.searchsorted(self.length, [length, length + 1])
            i = low + int(np.searchsorted(self.first[low:high], rank, side="right")) - 1
            return [(0, length, int(self.sequence[i] + rank - self.first[i]), int(self.offset[i]))]
        at = int(self.begin[length] + (rank - self.used[length]) * length)
        end, cuts = at + length, []
        while at < end:
            full = int(self.ends[0])
            if at < full:
                number, floor, ceiling = at // self.window, at // self.window * self.window, (at // self.window + 1) * self.window
            else:
                i = int(np.searchsorted(self.ends, at, side="right"))
                number, floor, ceiling = full // self.window + i - 1, int(self.ends[i - 1]), int(self.ends[i])
            upto = min(end, ceiling)
            cuts.append((length - (end - at), upto - at, self.stream + number, at - floor))
            at = upto
        return cuts


def solve(counts: dict[int, int], window: int, depth: int = DEPTH, steps: int = STEPS) -> Plan:
    """The plan for so many rests of each length from 1 to ``window - 1``."""
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, many in counts.items():
        histogram[length] = many
    combos = combinations(np.flatnonzero(histogram), window, depth)
    times = rounded(combos, repeats(combos, histogram.astype(np.float64), steps), histogram)
    runs: list[tuple[int, int, int, int]] = []
    used = np.zeros(window + 2, dtype=np.int64)
    sequences = 0
    for i in np.flatnonzero(times).tolist():
        offset = 0
        for length in combos[i][combos[i] > 0].tolist():
            runs.append((length, int(used[length]), sequences, offset))
            used[length] += times[i]
            offset += length
        sequences += int(times[i])
    runs.sort()
    residual = (histogram - used[:-1]) * np.arange(window + 1)
    # Longest first.
    begin = np.cumsum(residual[::-1])[::-1] - residual
    total = int(residual.sum())
    ends = [total // window * window]
    for bit in range(window.bit_length(), -1, -1):
        if total % window >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    columns = [np.array(c, dtype=np.int64) for c in zip(*runs, strict=True)] or [np.zeros(0, dtype=np.int64)] * 4
    return Plan(window, *columns, used, begin, np.array(ends), sequences, sequences + total // window + len(ends) - 1)


def _ranked(rests: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rests`` with ``_rank`` from 0 inside their length. A length is cut into buckets of about the root of all rows, ranked each and shifted by those before."""
    each = max(BUCKET_ROWS, math.isqrt(sum(counts.values())))
    spark = rests.sparkSession
    cuts = spark.createDataFrame([(n, -(-many // each)) for n, many in counts.items()], "length long, _buckets long")
    salted = rests.join(bounded_broadcast(cuts, len(counts)), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets"))).drop("_buckets")
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_many"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = settle(sizes.select("length", "_bucket", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_first")), "windows-starts")
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_row")) - 1
    return salted.withColumn("_inside", inside).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_inside") + F.col("_first"))


def pack_windows(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, depth: int = DEPTH, steps: int = STEPS) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: a row per piece, its ids as little-endian unsigned 32-bit numbers.

    The pieces of a sequence lie in it one behind the other from 0, and every id
    of a document lies in one piece. All sequences are full but the last few, whose
    sizes are powers of two, so nothing is padded. A null or empty text is the
    end id alone. Rows that repeat, or share or lack an id, are packed each.
    Columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    pair = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    pieces = pair.mapInArrow(_cut(tokenizer_path, window, end_id), PIECES).withColumn("_row", F.monotonically_increasing_id())
    pieces = settle(pieces, "windows-pieces")
    whole = pieces.filter(F.col("length") == window)
    rests = pieces.filter(F.col("length") < window)
    counts = {r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}  # fewer rows than a window has tokens
    plan = solve(counts, window, depth, steps)
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("array<struct<start:long,length:long,sequence_id:long,offset:long>>")
    def places(length, rank):
        import pandas as pd

        plan = shared.value
        names = ("start", "length", "sequence_id", "offset")
        return pd.Series([[dict(zip(names, p, strict=True)) for p in plan.parts(n, r)] for n, r in zip(length.tolist(), rank.tolist(), strict=True)])

    placed = _ranked(rests, counts).select("doc_id", "start", "ids", "doc_tokens", F.explode(places("length", "_rank")).alias("_p"))
    ids = F.substring("ids", (4 * F.col("_p.start") + 1).cast("int"), (4 * F.col("_p.length")).cast("int"))
    cut = placed.select(
        "doc_id", (F.col("start") + F.col("_p.start")).alias("start"), F.col("_p.length").alias("length"), ids.alias("ids"), "doc_tokens",
        (2 * F.col("_p.sequence_id") + 1).alias("sequence_id"), F.col("_p.offset").alias("offset"),
    )
    # Even numbers for sequences of one whole piece, odd ones for the plan's.
    alone = whole.select("doc_id", "start", "length", "ids", "doc_tokens", (2 * F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(cut)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_windows(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
