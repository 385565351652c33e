"""Repeated byte strings by a difference-cover sample of all suffixes.

Two places in a text, whatever their distance, have a common offset below the
modulus at which both are in the cover. A string of ``WINDOW`` bytes that occurs
twice therefore holds, at equal offsets, sampled places with equal tuples of
``WINDOW - MODULUS + 1`` bytes. So:

1. The tuples of the sampled suffixes are sorted, in shards by value, and named;
   names that occur once cannot begin a repeat and are dropped at once.
2. What the recursion orders beyond a tuple is here bounded by the window: a
   sampled place is ranked by its tuple with all bytes that a window around it
   can reach (its context). Equal contexts are folded to the first.
3. The remaining suffixes, up to ``MODULUS - 1`` bytes ahead of a sampled place,
   are merged through it: within a name, the windows at each offset are sorted,
   neighbours with equal bytes are compared by place, and all but the first are marked.

Marked windows become runs of bytes, and the texts are cut. No step holds more
than a bounded buffer, one text, or the contexts of one name in a task; very
common names are taken apart into single windows that Spark aggregates.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.llm.hashing import PIECE, byte_values, mix, running, spans, texts
from codepairs.llm.registry import query, table
from codepairs.session import release, settle, unsettle

WINDOW, MODULUS = 100, 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # every difference modulo 57 between two of these, each once
TUPLE = WINDOW - MODULUS + 1
REACH = MODULUS - 1  # bytes before a sampled place, and behind its tuple, that a window may hold

FLUSH = 4_000_000  # tuples sorted at once in a map task
SHARD = 8_000_000  # tuples named at once in a reduce task
HOT = 4096  # contexts of a name beyond which its windows are aggregated one by one
BUNCH = 20_000  # contexts of small names in one call

NAMES, CONTEXTS, FIRST, SECOND = (byte_values(i) for i in range(1, 5))
FAR = 4_294_967_296  # documents have fewer bytes


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each ``start`` (ascending) to its ``end``, piece by piece."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        upto = int(np.searchsorted(start, start[at] + PIECE))
        low, high = int(start[at]), int(end[at:upto].max())
        out[at:upto] = spans(running(data[low:high], values), start[at:upto] - low, end[at:upto] - low)
        at = upto
    return out


def sampled(n: int) -> np.ndarray:
    """The places of the cover in a text of ``n`` bytes at which a whole tuple begins."""
    places = (np.arange(0, n, MODULUS)[:, None] + np.array(COVER)).ravel()
    return places[places + TUPLE <= n]


def sampled_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sampled`` of texts that begin, and end, at ``bounds``: places within their texts, and the numbers of these."""
    size = np.diff(bounds)
    blocks = -(-size // MODULUS)
    text = np.repeat(np.arange(len(size)), blocks)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * MODULUS
    places, text = (begin[:, None] + np.array(COVER)).ravel(), np.repeat(text, len(COVER))
    whole = places + TUPLE <= size[text]
    return places[whole], text[whole]


def _parts(column: pa.Array, size: int = PIECE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes, or of one longer text: their rows, bytes and bounds."""
    data, bounds = texts(column)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield slice(at, upto), data[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at]
        at = upto


def names(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    return hashes(data, places, places + TUPLE, NAMES)


# -- shards of names, packed ------------------------------------------------------


def pack(ordered: np.ndarray) -> bytes:
    """Ascending numbers as differences of few bytes; those too large for that are listed."""
    if not len(ordered):
        return b""
    gaps = np.diff(ordered, prepend=ordered[:1])
    width = min(8, max(1, math.ceil((math.log2(int(ordered[-1] - ordered[0]) / len(ordered) + 1) + 3) / 8)))
    limit = np.uint64(256**width - 1)
    over = gaps >= limit
    low = np.where(over, limit, gaps).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<QQBQ", len(ordered), int(ordered[0]), width, int(over.sum())) + low.tobytes() + gaps[over].astype("<u8").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, dtype=np.uint64)
    n, first, width, large = struct.unpack_from("<QQBQ", packed)
    at = struct.calcsize("<QQBQ")
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(n, width)
    gaps = wide.view("<u8").ravel().copy()
    gaps[gaps == np.uint64(256**width - 1)] = np.frombuffer(packed, "<u8", large, at + n * width)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(first)


def _shard_row(shard: int, found: np.ndarray, docs: np.ndarray) -> dict:
    ids, which = np.unique(docs, return_inverse=True)
    kind = np.uint8 if len(ids) <= 1 << 8 else np.uint16 if len(ids) <= 1 << 16 else np.uint32
    least = int(ids[0])
    return {"shard": shard, "names": pack(found), "least": least, "ids": pack((ids - least).view(np.uint64)), "which": which.astype(kind).tobytes(), "width": kind().itemsize}


def _shard_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = unpack(row["ids"]).view(np.int64) + row["least"]
    return unpack(row["names"]), ids[np.frombuffer(row["which"], f"<u{row['width']}")]


SHARDS = "shard long, names binary, least long, ids binary, which binary, width int"
PACKED = pa.schema([("shard", pa.int64()), ("names", pa.binary()), ("least", pa.int64()), ("ids", pa.binary()), ("which", pa.binary()), ("width", pa.int32())])


def _sample(bits: int, shards: int, most: int):
    """Sorted names of the sampled places with the documents they are in, cut into shards by value.

    A name that occurs more than once in a buffer is known to be repeated: its
    places go to a shard of such, below zero, and one of them stands for all.
    """
    shift = np.uint64(64 - bits)

    def flush(found: list[np.ndarray], docs: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        value, doc = np.concatenate(found), np.concatenate(docs)
        order = np.argsort(value)
        value, doc = value[order], doc[order]
        again = np.zeros(len(value), dtype=bool)
        again[1:] = value[1:] == value[:-1]
        known = again.copy()
        known[:-1] |= again[1:]
        rows = [_shard_row(-1 - turn % shards, value[known], doc[known])] if known.any() else []
        value, doc = value[~again], doc[~again]
        bounds = np.array([-(-(i << bits) // shards) for i in range(shards)], dtype=np.uint64)
        shard = np.searchsorted(bounds, value, side="right") - 1
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(value)]
        rows += [_shard_row(int(shard[a]), value[a:b], doc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        yield from pa.Table.from_pylist(rows, schema=PACKED).to_batches(max_chunksize=64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held, turn = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for rows, data, bounds in _parts(batch.column("text"), max(1, min(PIECE, most * MODULUS // len(COVER)))):
                places, text = sampled_of(bounds)
                found.append(names(data, places + bounds[text]) >> shift)
                docs.append(ids[rows][text])
                held += len(places)
                if held >= most:
                    yield from flush(found, docs, turn)
                    turn += 1 + int(ids[rows][-1]) % 1009
                    found, docs, held = [], [], 0
        if held:
            yield from flush(found, docs, turn)

    return sample


def _bytes_of(bits: int) -> int:
    return -(-bits // 8)


def _short(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _name(rows: pa.Table, width: int, bunches: int) -> pa.Table:
    """The repeated names of a shard in ``width`` bytes each, by document, a row per bunch of documents."""
    shard = rows.column("shard")[0].as_py()
    parts = [_shard_of(row) for row in rows.to_pylist()]
    value, doc = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
    if shard >= 0:
        order = np.argsort(value)
        value, doc = value[order], doc[order]
        again = value[1:] == value[:-1]
        known = np.zeros(len(value), dtype=bool)
        known[1:] |= again
        known[:-1] |= again
        value, doc = value[known], doc[known]
    bunch = (mix(doc.view(np.uint64)) % np.uint64(bunches)).view(np.int64)
    order = np.lexsort((doc, bunch))
    value, doc, bunch = value[order], doc[order], bunch[order]
    begins = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1) | np.diff(bunch, prepend=bunch[:1] - 1))
    many = np.diff(np.append(begins, len(doc)))
    of = bunch[begins]
    firsts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1))
    cuts = [*firsts.tolist(), len(begins)]
    at = [*begins[firsts].tolist(), len(value)]
    rows = [
        (int(of[a]), doc[begins[a:b]].tobytes(), many[a:b].tobytes(), _short(value[low:high], width))
        for a, b, low, high in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True)
    ]
    return pa.Table.from_pylist([dict(zip(NAMED.names, row, strict=True)) for row in rows], schema=NAMED)


NAMED = pa.schema([("bunch", pa.int64()), ("docs", pa.binary()), ("many", pa.binary()), ("names", pa.binary())])


def _of_bunch(rows: pa.Table, width: int) -> pa.Table:
    """The names of a bunch from all shards, a row per document."""
    docs, many = (np.concatenate([np.frombuffer(c, dtype=np.int64) for c in rows.column(k).to_pylist()]) for k in ("docs", "many"))
    value = np.frombuffer(b"".join(rows.column("names").to_pylist()), dtype=f"V{width}")
    doc = np.repeat(docs, many)
    order = np.argsort(doc, kind="stable")
    ids, begins = np.unique(doc[order], return_index=True)
    ends = (np.append(begins, len(doc)) * width).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(value[order].tobytes())])
    return pa.table([pa.array(ids, pa.int64()), found.cast(pa.binary())], names=["doc_id", "names"])


# -- contexts ---------------------------------------------------------------------


def reach(places: np.ndarray, n: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around sampled places that windows over their tuples may hold, within a text of ``n`` bytes."""
    return np.maximum(places - REACH, 0), np.minimum(places + TUPLE + REACH, n)


def _meant(data: np.ndarray, bounds: np.ndarray, only: pa.Array) -> np.ndarray:
    """Of several texts under one id, the one that takes part."""
    cuts = zip(bounds[:-1].tolist(), bounds[1:].tolist(), only.to_pylist(), strict=True)
    return np.array([meant is None or hashlib.sha256(data[a:b]).hexdigest() == meant for a, b, meant in cuts], dtype=bool)


MEMBERS = "doc_id long, place long, name long, context long"


def _members(bits: int):
    shift = np.uint64(64 - bits)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sampled places with repeated names, each with a hash of its context."""
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for rows, data, bounds in _parts(batch.column("text")):
                # A name is repeated or not, in whichever of the texts it stands.
                wanted = np.unique(_long(b"".join(batch.column("names")[rows].to_pylist()), _bytes_of(bits)))
                places, text = sampled_of(bounds)
                value = names(data, places + bounds[text])
                short = value >> shift
                here = wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short
                here &= _meant(data, bounds, batch.column("only")[rows])[text]
                places, text, value = places[here], text[here], value[here]
                low, high = reach(places, np.diff(bounds)[text])
                context = hashes(data, low + bounds[text], high + bounds[text], CONTEXTS) ^ ((places - low).astype(np.uint64) << np.uint64(1))
                columns = [ids[rows][text], places, value.view(np.int64), context.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "place", "name", "context"])

    return members


WINDOWS = "name long, doc_id long, place long, low long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, and where they begin."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for rows, data, bounds in _parts(batch.column("text")):
            text, (name, places) = _listed(batch.column("asked")[rows], "name", "place")
            here = _meant(data, bounds, batch.column("only")[rows])[text]
            text, name, places = text[here], name[here], places[here]
            # Contexts that overlap lie side by side, which packs them well.
            order = np.lexsort((places, text))
            text, name, places = text[order], name[order], places[order]
            low, high = reach(places, np.diff(bounds)[text])
            data = data.tobytes()
            cut = [data[a:b] for a, b in zip((low + bounds[text]).tolist(), (high + bounds[text]).tolist(), strict=True)]
            columns = [pa.array(c, pa.int64()) for c in (name, ids[rows][text], places, low)] + [pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "place", "low", "bytes"])


def _listed(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The structs of a list column as arrays, with the row that each is in."""
    many = column.value_lengths().to_numpy()
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), many), [flat.field(f).to_numpy() for f in fields]


def _starts(rows) -> tuple[np.ndarray, ...]:
    """For every window of the contexts: the number of its row, its start relative to the sampled place, and two hashes."""
    column = rows.column("bytes")
    data, bounds = texts(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    sizes = np.diff(bounds)
    many = np.maximum(sizes - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(sizes)), many)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(np.cumsum(sizes) - sizes, many) + inside
    ahead = rows.column("place").to_numpy() - rows.column("low").to_numpy()
    offset = inside - ahead[row]
    return row, offset, hashes(data, start, start + WINDOW, FIRST), hashes(data, start, start + WINDOW, SECOND)


def _mark(rows: pa.Table) -> pa.Table:
    """The starts of all windows that equal one which begins earlier, by document, within names."""
    row, offset, first, second = _starts(rows)
    doc, place, name = (rows.column(c).to_numpy() for c in ("doc_id", "place", "name"))
    start = place[row] + offset
    # Equal windows of a name lie side by side, the earliest ahead.
    key = first ^ mix((name[row] + offset * 57).view(np.uint64))
    order = np.lexsort((start, doc[row], key))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    # Rows that share an id may hold the same window at the same start: neither is earlier.
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    marked = order[same & ((doc[row[lead]] != doc[row[order]]) | (start[lead] != start[order]))]
    return _by_document(doc[row[marked]], start[marked])


def _by_document(doc: np.ndarray, start: np.ndarray) -> pa.Table:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WINDOW)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return pa.table([pa.array(doc[first], pa.int64()), pa.array(start[first], pa.int64()), pa.array(start[last] + WINDOW, pa.int64())], names=["doc_id", "low", "high"])


RUNS = "doc_id long, low long, high long"


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of very common names as rows."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            row, offset, first, second = _starts(part)
            doc, place = (part.column(c).to_numpy() for c in ("doc_id", "place"))
            columns = [doc[row], place[row] + offset, first.view(np.int64), second.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "first", "second"])


# -- the whole ----------------------------------------------------------------------


def _place(doc_id: Column, place: Column) -> Column:
    return (doc_id.cast("decimal(20,0)") * F.lit(FAR).cast("decimal(10,0)") + place.cast("decimal(10,0)")).cast("decimal(38,0)")


def repeated_runs(rows: DataFrame, n_bytes: int, only: DataFrame, folded_ids: DataFrame) -> DataFrame:
    """``doc_id, low, high``, stored: runs of bytes under windows that begin earlier as well.

    ``rows`` holds ``doc_id`` and ``text`` (binary) of at least a window;
    ``n_bytes`` is about their size together, which sets the width of names, so
    that few are equal by chance, and the number of shards. ``only`` (``_id, only``) has the digest of
    the text that is meant where an id has several; ``folded_ids`` (``_copy``) are left out.
    """
    spark = rows.sparkSession
    tuples = max(1, n_bytes * len(COVER) // MODULUS)
    bits = min(64, math.ceil(math.log2(tuples + 1)) + 14)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tuples // SHARD))
    sharded = rows.mapInArrow(_sample(bits, shards, FLUSH), SHARDS)
    named = sharded.groupBy("shard").applyInArrow(lambda t: _name(t, _bytes_of(bits), shards), "bunch long, docs binary, many binary, names binary")
    named = settle(named, "suffix-names")
    del sharded
    release(spark)

    def of_documents(found: DataFrame) -> DataFrame:
        """The texts with what was found in them under ``_doc``."""
        told = found.join(only, F.col("_doc") == F.col("_id"), "left").drop("_id")
        # It grows with the documents, so it is not broadcast while it happens to be small.
        return rows.join(told.hint("merge"), F.col("doc_id") == F.col("_doc")).drop("_doc")

    wanted = named.groupBy("bunch").applyInArrow(lambda t: _of_bunch(t, _bytes_of(bits)), "doc_id long, names binary").withColumnRenamed("doc_id", "_doc")
    held = of_documents(wanted.join(folded_ids, F.col("_doc") == F.col("_copy"), "left_anti"))
    members = settle(held.mapInArrow(_members(bits), MEMBERS), "suffix-members")
    unsettle(named)
    del held, wanted
    release(spark)

    at = _place(F.col("doc_id"), F.col("place"))
    folded = members.groupBy("name", "context").agg(F.min(at).alias("first"), F.count("*").alias("many"))
    folded = settle(folded, "suffix-folded")
    release(spark)
    # A context that stands earlier as a whole: all windows in it do.
    more = folded.filter("many > 1").select(F.col("name").alias("_name"), F.col("context").alias("_context"), "first")
    later = members.join(more, (F.col("name") == F.col("_name")) & (F.col("context") == F.col("_context"))).filter(at > F.col("first"))
    copies = settle(later.select("doc_id", "place"), "suffix-copies")
    unsettle(members)
    del later
    release(spark)

    # Windows of names with several contexts are compared with each other.
    several = folded.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("contexts")).filter("contexts > 1")
    several = settle(several, "suffix-several")
    size = F.lit(FAR).cast("decimal(10,0)")
    place = F.pmod("first", size)
    asked = folded.join(several, F.col("name") == F.col("_name"), "left_semi")
    asked = asked.select(((F.col("first") - place) / size).cast("long").alias("_doc"), F.struct("name", place.cast("long").alias("place")).alias("ask"))
    held = of_documents(asked.groupBy("_doc").agg(F.collect_list("ask").alias("asked")))
    contexts = settle(held.mapInArrow(_contexts, WINDOWS), "suffix-contexts")
    unsettle(folded)
    del held, asked
    release(spark)

    bunches = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() // BUNCH))
    hot = settle(several.filter(F.col("contexts") > HOT).select("_name"), "suffix-hot")
    common = contexts.join(hot, F.col("name") == F.col("_name"), "left_semi")
    usual = contexts.join(hot, F.col("name") == F.col("_name"), "left_anti").withColumn("bunch", F.pmod(F.xxhash64("name"), F.lit(bunches)))
    marked = usual.groupBy("bunch").applyInArrow(lambda t: _mark(t), RUNS)
    single = settle(common.mapInArrow(_single, "doc_id long, start long, first long, second long"), "suffix-single")
    at = _place(F.col("doc_id"), F.col("start"))
    earliest = settle(single.groupBy("first", "second").agg(F.min(at).alias("_at"), F.count("*").alias("n")).filter("n > 1"), "suffix-earliest")
    earliest = earliest.select(F.col("first").alias("_first"), F.col("second").alias("_second"), "_at")
    again = single.join(earliest, (F.col("first") == F.col("_first")) & (F.col("second") == F.col("_second"))).filter(at > F.col("_at"))
    again = again.select("doc_id", F.col("start").alias("low"), (F.col("start") + WINDOW).alias("high"))
    # How far a context reaches at the ends of a text is settled when the text is cut.
    whole = copies.select("doc_id", (F.col("place") - REACH).alias("low"), (F.col("place") + TUPLE + REACH).alias("high"))
    runs = settle(marked.unionByName(again).unionByName(whole), "suffix-runs")
    unsettle(contexts, copies, single)
    return runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its runs."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for rows, data, bounds in _parts(batch.column("text")):
            text, (low, high) = _listed(batch.column("runs")[rows], "low", "high")
            here = _meant(data, bounds, batch.column("only")[rows])[text]
            text, low, high = text[here], low[here], high[here]
            size = np.diff(bounds)
            steps = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(steps, np.clip(low, 0, size[text]) + bounds[text], 1)
            np.add.at(steps, np.clip(high, 0, size[text]) + bounds[text], -1)
            gone = np.cumsum(steps[:-1]) > 0
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            # Runs do not go on from text to text.
            starts[bounds[:-1]] = gone[bounds[:-1]]
            removed, spans_ = (np.add.reduceat(c, bounds[:-1], dtype=np.int64) for c in (gone, starts))
            kept = data[~gone].tobytes()
            ends = np.cumsum(size - removed).tolist()
            digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            columns = [pa.array(c, pa.int64()) for c in (ids[rows], size, removed, spans_)] + [pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A byte goes if a string of 100 bytes over it starts earlier too: in a
    document of smaller id, or earlier in its own. Strings are judged on the
    texts as they came. Null and empty texts have no bytes. A row with a null id
    keeps all, and nothing is compared with it. Rows that share an id and a text
    are one document, each told; of several texts under one id only that of the
    smallest digest takes part, and the others keep all. Extra columns are
    ignored; an empty table gives an empty one.
    """
    text = F.coalesce(docs["text"].cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    sizes = settle(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")), "suffix-sizes")
    long = sizes.filter((F.col("n_bytes") >= WINDOW) & F.col("doc_id").isNotNull())
    several = long.groupBy("doc_id").agg(F.min("digest").alias("only"), F.max("digest").alias("_other")).filter("only < _other")
    only = settle(several.select(F.col("doc_id").alias("_id"), "only"), "suffix-only")
    meant = long.join(only, F.col("doc_id") == F.col("_id"), "left").filter("only is null or only = digest").select("doc_id", "n_bytes", "digest")

    # Texts that stand in a document of smaller id go as a whole, and are no one's only source.
    same = meant.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most")
    same = settle(same.select(F.col("digest").alias("_digest"), "_least"), "suffix-same")
    copies = meant.join(same, F.col("digest") == F.col("_digest")).filter(F.col("doc_id") > F.col("_least"))
    copies = settle(copies.select(F.col("doc_id").alias("_copy"), F.col("digest").alias("_whole")).distinct(), "suffix-whole")

    usable = rows.filter((F.octet_length("text") >= WINDOW) & F.col("doc_id").isNotNull())
    runs = repeated_runs(usable, long.agg(F.sum("n_bytes")).first()[0] or 0, only, copies.select("_copy"))
    by_doc = runs.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("low", "high")).alias("runs"))  # as the document is long, at most
    by_doc = settle(by_doc.join(only, F.col("_doc") == F.col("_id"), "left").drop("_id"), "suffix-by-document")
    unsettle(runs)
    release(docs.sparkSession)
    cut = usable.join(by_doc.hint("merge"), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "only", "runs").mapInArrow(_cut, REPORT)

    # What is not cut is told by its size and digest alone.
    flags = by_doc.select(F.col("_doc").alias("_flag"))
    rest = sizes.join(flags, (F.col("doc_id") == F.col("_flag")) & (F.col("n_bytes") >= WINDOW), "left_anti")
    rest = rest.join(copies, (F.col("doc_id") == F.col("_copy")) & (F.col("digest") == F.col("_whole")), "left")
    gone = F.col("_copy").isNotNull()
    rest = rest.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    return cut.unionByName(rest)


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))
