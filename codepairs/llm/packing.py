"""Best-fit packing of token sequences in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so documents and gaps, sorted by
size, fall into at most ``capacity`` classes, and all members of a class are
alike but for their rank in it. Spark counts the pieces by length and ranks them
inside their length, in salted buckets. A round takes the longest class that is
left, sweeps the gaps upward from the first that can hold it (the successor),
gives the gaps out by rank, and updates them. Rounds need only the class sizes:
their input is bounded by the capacity, whatever the number of documents, and
so is the plan of placements, which Spark then applies to every piece by length
and rank.
"""

from __future__ import annotations

import bisect
import codecs
import json
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.session import settle

# The sequence length and the id that ends a document.
CAPACITY = 4096
END_ID = 1
# The text whose words are told apart at a time, the words encoded in one call, and the least rows of a bucket of ranks.
SLICE_BYTES = 8 << 20
WORDS_AT_ONCE = 20_000
BUCKET_ROWS = 500

# The rules of a file, as far as they come before merging, under which words are parted here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Words of Latin and Cyrillic signs, all composed, with one small form that is of these signs too, and the classes of the rule in these.
BETWEEN = "\0"
PLAIN = r"^[\x{01}-\x{12f}\x{131}-\x{17f}\x{400}-\x{45f}]*$"
LETTERS, NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f\u0430-\u045f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PART = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}\0\x85\xa0]+")
# Bytes as the signs that merges are written in; the space stays, as it stands between parts.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in SHOWN]
BYTE_SIGNS = "".join(" " if b == 32 else chr(256 + HIDDEN.index(b)) if b in HIDDEN else chr(b) for b in range(256))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _joined(words: pa.Array, sign: str) -> str:
    offsets = pa.array([0, len(words)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), sign)[0].as_py()


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` of these codes, one after the other."""
    each = lengths[codes]
    ends = np.cumsum(each)
    return ids[np.repeat(starts[codes] - ends + each, each) + np.arange(each.sum())]


def _at_once(encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` for a bounded number of words at a time, as its tokens take much memory."""
    found = [encode(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)]
    ids, lengths = zip(*found, strict=True) if found else ([np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)])
    return np.concatenate(ids), np.concatenate(lengths)


class WordEncoder:
    """Encodes texts by their distinct words, as little-endian 32-bit ids; a few MB of text at a time, so its memory is bounded.

    Holds for tokenizers that never join characters across white space, as those
    do that split before they merge: the ids of a text are then the ids of its
    words in turn. Where the file's rules are those that are restated above, words of
    signs whose small and composed forms leave no doubt are parted here, and parts
    are merged without the file's normalizer and expressions. Other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        ends = {i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")}
        self.ends = np.isin(np.arange(self.tokenizer.get_vocab_size()), list(ends))
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = WhitespaceSplit()
        rules = [json.loads(part.__getstate__()) if part else None for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.parted = rules == [NORMALIZER, PRE_TOKENIZER]

    def _plain(self, words: pa.Array) -> np.ndarray:
        if not self.parted:
            return np.zeros(len(words), dtype=bool)
        plain = pc.match_substring_regex(words, PLAIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        return plain.to_numpy(zero_copy_only=False)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        each = self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)
        return np.array([i for e in each for i in e.ids], dtype="<u4"), np.array([len(e.ids) for e in each], dtype=np.int64)

    def _merge(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole``, for parts of words; they are joined for one call and told apart at the ids that end one."""
        signs, _ = codecs.charmap_decode(_joined(parts, " ").encode(), "strict", BYTE_SIGNS)
        ids = np.array(self.merger.encode_batch_fast([signs], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(parts) else self._whole(parts)

    def _from_parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_whole``, for words that are plain: every distinct part of them is merged once."""
        coded = pa.array(PART.findall(_joined(words, BETWEEN).lower() + BETWEEN), pa.string()).dictionary_encode()
        codes, between = coded.indices.to_numpy(), pc.index(coded.dictionary, BETWEEN).as_py()
        ids, lengths = _at_once(self._merge, pc.filter(coded.dictionary, pc.not_equal(coded.dictionary, BETWEEN)))
        lengths = np.insert(lengths, between, 0)
        return _gather(ids, np.cumsum(lengths) - lengths, lengths, codes), np.diff(np.cumsum(lengths[codes])[codes == between], prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, in any order, where those of a word start, and how many it has."""
        plain = self._plain(words)
        some, many = self._from_parts(words.filter(pa.array(plain))) if plain.any() else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
        others, of_others = _at_once(self._whole, words.filter(pa.array(~plain)))
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[plain], lengths[~plain] = many, of_others
        starts = np.zeros(len(words), dtype=np.int64)
        starts[plain], starts[~plain] = np.cumsum(many) - many, np.cumsum(of_others) - of_others + len(some)
        return np.concatenate([some, others]), starts, lengths

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        yield from self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, null being empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            # Splits at the six signs of ASCII alone. Where a text begins or ends with one, there is an empty word.
            split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, upto - at), ""))
            coded = split.flatten().dictionary_encode()
            ids, starts, lengths = self._words(coded.dictionary)
            codes = coded.indices.to_numpy()
            flat, filled = _gather(ids, starts, lengths, codes), np.append(0, np.cumsum(lengths[codes]))
            text_ends = filled[np.cumsum(split.value_lengths().to_numpy())].tolist()
            yield from (flat[a:b] for a, b in zip([0, *text_ends], text_ends, strict=False))
            at = upto


_encoders: dict[str, WordEncoder] = {}


def _cut(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_column(batch.column("text")), strict=True):
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every document, with the digest of their ids; null text is empty."""
    pair = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return pair.mapInArrow(_cut(tokenizer_path, capacity, end_id), PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, first rank, first sequence, pieces per sequence, offset)`` for so many pieces of each length.

    The piece of rank ``r`` goes to sequence ``first sequence + (r - first rank) // per`` at
    ``offset + (r - first rank) % per * length``. Sequences with the same gap are held as runs of ids.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []  # gap sizes that have sequences, ascending
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            else:
                gap, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            per = gap // length
            full, rest = divmod(min(left, many * per), per)
            plan.append((length, rank, first, per, capacity - gap))
            leave(gap - per * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), many - full - bool(rest))
            rank, left = rank + full * per + rest, left - full * per - rest
    return plan


def _ranked(stored: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``stored`` with ``_rank``, the place of a piece among those of its length, from 0.

    A length is cut into buckets of about the root of all rows, so that neither
    the rows of a bucket nor the buckets of a length become many. Ranks run inside buckets
    and start where the smaller buckets of the same length end.
    """
    each = max(BUCKET_ROWS, math.isqrt(sum(counts.values())))
    cuts = stored.sparkSession.createDataFrame([(n, -(-many // each)) for n, many in counts.items()], "length long, _buckets long")
    # One row per length on the right, of which there are at most as many as the capacity.
    salted = stored.join(F.broadcast(cuts), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets")))
    inside = W.partitionBy("length", "_bucket").orderBy("_row")
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_many"))
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_first"))
    ranked = salted.withColumn("_inside", F.row_number().over(inside) - 1).join(settle(starts, "pack-starts"), ["length", "_bucket"])
    return ranked.withColumn("_rank", F.col("_inside") + F.col("_first")).drop("_buckets", "_bucket", "_inside", "_first", "_row")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    Every row is placed, repeated rows each on their own; columns other than
    these two are kept as they are. No rows give no sequences.
    """
    stored = settle(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = sorted(best_fit(counts, capacity))
    columns = [np.array(c, dtype=np.int64) for c in zip(*plan, strict=True)] or [np.zeros(0, dtype=np.int64)] * 5
    if not plan:
        return stored.drop("_row").withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset")})
    shared = stored.sparkSession.sparkContext.broadcast(columns)
    ranked = _ranked(stored, counts).select(*pieces.columns, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, firsts, pers, offsets = shared.value
        # Length and rank in one number that sorts like the pair: 23 bits and 40 bits.
        keys = lengths * (1 << 40) + ranks
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            ahead = rank - ranks[at]
            found = [firsts[at] + ahead // pers[at], offsets[at] + ahead % pers[at] * length]
            kept = [c for c in batch.schema.names if c != "_rank"]
            arrays = [batch.column(c) for c in kept] + [pa.array(f) for f in found]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    kept = ranked.drop("_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs: a row per piece with its sequence and offset.

    Null and empty texts are documents of the end id alone. Only documents
    longer than the capacity are cut. Rows that repeat are packed each.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
