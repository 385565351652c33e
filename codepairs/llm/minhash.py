"""Near-duplicate documents by SuperMinHash, banding, exact verification and connected components.

The signature follows Ertl, "SuperMinHash" (2017): every shingle visits the
slots in an order of its own, and at step ``j`` offers the slot the number
``j + r`` with ``r`` in [0, 1), so the values of one shingle are correlated ranks
and a document is done as soon as all slots hold less than the next step. The
orders are full cycles drawn from the shingle's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.llm.components import components, spanning
from codepairs.llm.hashing import mix, shingle_sets, texts, word_hashes
from codepairs.llm.registry import query, table
from codepairs.session import settle

SLOTS = 256  # a power of two
MISS = 1e-5  # most a pair at the threshold may fail to meet in any band
BLOCK_ROWS = 512  # documents compared at once, on either side
BUNCH_ROWS = 4096  # documents of small groups in one task call


def band_rows(percent: int, slots: int = SLOTS) -> int:
    """The most slots per band at which a pair of ``percent`` similarity meets with probability ``1 - MISS``."""
    return max(r for r in range(1, slots) if r == 1 or (1 - (percent / 100) ** r) ** (slots // r) <= MISS)


def super_minhash(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of hashes; slots of an empty set are infinite."""
    values = np.full(slots, np.inf)
    if not len(shingles):
        return values
    x = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    step, place = (x >> np.uint64(32)) | np.uint64(1), x & np.uint64(0xFFFFFFFF)
    j, many = 0, 1
    # As many steps at once as fill the slots twice over on average; a few rounds are enough for most.
    while j < slots and not values.max() < j:
        many = min(slots - j, max(1, 2 * slots // len(shingles)))
        turns = np.arange(j, j + many, dtype=np.uint64)
        slot = (place[:, None] + step[:, None] * turns) & np.uint64(slots - 1)
        rank = (mix(shingles[:, None] ^ mix(turns + np.uint64(0xD1B54A32D192ED03))) >> np.uint64(11)) * 2.0**-53 + turns
        np.minimum.at(values, slot.ravel().astype(np.int64), rank.ravel())
        j += many
    return values


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A hash per band and document; the number of the band is part of it."""
    bands = signatures.shape[1] // rows
    bits = signatures.view(np.uint64)[:, : bands * rows].reshape(len(signatures), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return keys.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, bounds = texts(column)
    yield from shingle_sets(*word_hashes(data, bounds), size)


def _sketch(size: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part.column("text"), size))
                keys = band_keys(np.array([super_minhash(s) for s in sets]), rows)
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
                counts = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), counts, pa.array([_digest(s) for s in sets], pa.binary()), bands], ["doc_id", "n_shingles", "digest", "bands"]
                )

    return sketch


def _wanted(size: int):
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The full sets of candidate documents, each once; a row of the same id with another text is not meant."""
        seen: set[int] = set()  # rows that repeat come to one task, or to a few if they are very many, which does no harm
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                kept, found = [], []
                for i, (node, digest, own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("node", "digest")), _sets(part.column("text"), size), strict=True)):
                    if node not in seen and _digest(own) == digest:
                        seen.add(node)
                        kept.append(i)
                        found.append(own.tobytes())
                rows = part.select(["node", "group"]).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], ["node", "group", "shingles"])

    return wanted


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of incidence matrices."""
    sets = [*left, *right]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    held = often[column]
    column, owner = number[column[held]], owner[held]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    width = max(64, min(4096, (1 << 22) // len(sets)))
    total = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, total + width, width))
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - n * width] = 1
        out += np.rint(part[: len(left)] @ part[len(left) :].T).astype(np.int64)
    return out


def _verify(percent: int):
    def verify(rows: pa.Table) -> pa.Table:
        """Edges of a spanning forest of the links between the left and the right documents of each group."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        groups = rows.column("group").to_numpy()
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.diff(groups[order])) + 1
        nodes, is_left, is_right = (rows.column(c).to_numpy() for c in ("node", "is_left", "is_right"))
        sets = rows.column("shingles")
        for members in np.split(order, cuts):
            left, right = members[is_left[members]], members[is_right[members]]
            if not len(left) or not len(right):
                continue
            a, b = ([np.frombuffer(sets[int(i)].as_py(), dtype=np.uint64) for i in side] for side in (left, right))
            both = shared(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
            near = (100 * both >= percent * union) & (nodes[left][:, None] != nodes[right][None, :])
            i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            square = np.zeros((len(i) + len(j),) * 2, dtype=bool)
            square[: len(i), len(i) :] = near[np.ix_(i, j)]
            square |= square.T
            node, root = spanning(square)
            names = np.concatenate([nodes[left][i], nodes[right][j]])
            out.append((names[node], names[root]))
        u, v = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return verify


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of all that is linked, ``sets`` being ``(node, group, shingles)``.

    A group of up to a block is compared whole, many groups in a call. Of a
    larger one every document first meets one block of pivots. What that has
    joined needs no more comparisons inside, so afterwards only the documents
    outside the largest component meet all blocks.
    """
    spark = sets.sparkSession
    verify = _verify(percent)
    sizes = settle(sets.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "mh-sizes")
    rows = sets.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    shape = ["bunch", "i", "j", "group", "node", "shingles", "is_left", "is_right"]
    bunches = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() // BUNCH_ROWS))
    yes, no = F.lit(True), F.lit(False)

    def shaped(df: DataFrame, bunch, i, j, is_left, is_right) -> DataFrame:
        named = {"bunch": bunch, "i": i, "j": j, "is_left": is_left, "is_right": is_right}
        return df.withColumns({k: v.cast("long") if k in ("bunch", "i", "j") else v for k, v in named.items()}).select(*shape)

    zero = F.lit(0)
    small = shaped(rows.filter("blocks = 1"), F.pmod(F.xxhash64("group"), F.lit(bunches)), F.lit(-1), zero, yes, yes)
    large = rows.filter("blocks > 1")
    pivots = large.filter("block = 0").withColumn("_j", F.explode(F.sequence(zero.cast("long"), F.col("blocks") - 1)))
    pivots = shaped(pivots, F.col("group"), zero, F.col("_j"), yes, no)
    others = shaped(large, F.col("group"), zero, F.col("block"), no, yes)
    keys = ["bunch", "i", "j"]
    edges = "u long, v long"
    first = settle(small.unionByName(pivots).unionByName(others).groupBy(*keys).applyInArrow(verify, edges), "mh-links")
    joined = components(first)
    if sizes.filter("blocks > 1").isEmpty():
        return joined
    joined = settle(joined, "mh-joined")
    labels = large.select("node", "group", "blocks").join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
    labels = settle(labels.select("node", "group", "label"), "mh-labels")
    counts = labels.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = settle(counts.groupBy("group").agg(F.max_by("label", "n").alias("main")), "mh-main")
    rest = settle(labels.join(main, "group").filter("label <> main").select(F.col("node").alias("_rest")), "mh-rest")
    if rest.isEmpty():
        return joined
    outside = settle(large.join(rest, F.col("node") == F.col("_rest"), "left_semi"), "mh-outside")
    left_blocks = outside.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("lefts"))
    left_blocks = settle(left_blocks, "mh-lefts")
    left = outside.join(left_blocks, "group").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("lefts")))
    left = left.withColumn("_j", F.explode(F.sequence(zero.cast("long"), F.col("blocks") - 1)))
    right = large.join(left_blocks, "group").withColumn("_i", F.explode(F.sequence(zero.cast("long"), F.col("lefts") - 1)))
    second = shaped(left, F.col("group"), F.col("_i"), F.col("_j"), yes, no)
    second = second.unionByName(shaped(right, F.col("group"), F.col("_i"), F.col("block"), no, yes))
    more = settle(second.groupBy(*keys).applyInArrow(verify, edges), "mh-links")
    # A component is by now as good as its edges.
    held = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return joined if more.isEmpty() else components(held.unionByName(more))


def near_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents whose sets of ``size``-word shingles have 100 * intersection >=
    ``percent`` * union are linked, which is confirmed on the full sets, and
    components take the smallest id of theirs. A to Z count as a to z; a text
    with fewer words is one shingle; one without words, or null, has none and
    links with nothing. Documents with equal sets are folded before banding.

    A row with a null id is not compared (component null, kept). Rows that share
    an id are compared each by its text, and equal ones are all kept. Extra
    columns are ignored; an empty table gives an empty one.
    """
    rows = band_rows(percent)
    pair = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    sketched = pair.mapInArrow(_sketch(size, rows), "doc_id long, n_shingles long, digest binary, bands array<long>")
    sketches = settle(sketched, "mh-sketches")
    named = sketches.filter("doc_id is not null and n_shingles > 0")
    folded = named.groupBy("digest").agg(F.min("doc_id").alias("least"))
    nodes = settle(folded.withColumn("node", F.monotonically_increasing_id()), "mh-nodes")

    # One row per distinct set stands for its copies in the bands.
    of = nodes.select("node", F.col("digest").alias("_digest"), "least")
    chosen = sketches.join(of, (F.col("doc_id") == F.col("least")) & (F.col("digest") == F.col("_digest")))
    banded = settle(chosen.select("node", "bands"), "mh-bands").select("node", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("_last")).filter("head < _last")
    heads = settle(heads.select(F.col("key").alias("_key"), "head"), "mh-heads")
    met = banded.join(heads, F.col("key") == F.col("_key")).filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    candidates = settle(components(met).withColumnRenamed("component", "group"), "mh-candidates")

    of = candidates.join(nodes, "node").select("node", "group", F.col("least").alias("_id"), "digest")
    # Candidates grow with the documents, so their list is not broadcast while it happens to be small.
    found = pair.join(settle(of, "mh-wanted").hint("merge"), F.col("doc_id") == F.col("_id")).select("node", "group", "digest", "text")
    sets = settle(found.mapInArrow(_wanted(size), "node long, group long, shingles binary"), "mh-sets")
    joined = _joined(sets, percent)

    labels = nodes.join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    labels = settle(labels.select("digest", "least", F.coalesce("component", "node").alias("label")), "mh-labels")
    least = settle(labels.groupBy("label").agg(F.min("least").alias("component_id")), "mh-least")
    told = settle(labels.join(least, "label").select(F.col("digest").alias("_digest"), "component_id"), "mh-told")
    every = sketches.join(told, (F.col("digest") == F.col("_digest")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return every.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that are not the first of their component; all columns are kept.

    Of rows that share an id and a text one is kept; of those that share an id alone, each is judged by its own text, in the
    order of the texts' digests. Rows with a null id stay.
    """
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    own = F.col("_row.doc_id")
    if docs.filter(docs["doc_id"].isNotNull()).groupBy(docs["doc_id"]).count().filter("count > 1").isEmpty():
        gone = settle(near_documents(docs, size, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "mh-gone")
        return row.join(gone, own == F.col("_gone"), "left_anti").select("_row.*")
    # Ids repeat: places in the order of id and text stand for them.
    named = row.filter(own.isNotNull()).select("_row", own.cast("long").alias("_id"), F.col("_row.text").alias("text"))
    named = named.withColumn("_key", F.concat(F.col("text").isNull().cast("string"), F.md5(F.coalesce("text", F.lit(""))))).dropDuplicates(["_id", "_key"])
    placed = named.repartitionByRange("_id", "_key").sortWithinPartitions("_id", "_key")
    placed = settle(placed.select("_row", "text", F.monotonically_increasing_id().alias("doc_id")), "mh-placed")
    gone = near_documents(placed.select("doc_id", "text"), size, percent).filter("not kept").select(F.col("doc_id").alias("_gone"))
    left = placed.join(settle(gone, "mh-gone"), F.col("doc_id") == F.col("_gone"), "left_anti").select("_row")
    return left.unionByName(row.filter(own.isNull())).select("_row.*")


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) END) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
near AS MATERIALIZED (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * met >= 85 * (p.n + q.n - met)),
reach(u, v) AS (SELECT u, v FROM near UNION SELECT r.u, e.v FROM reach r JOIN near e ON r.v = e.u),
least AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON u = d.doc_id"""


@query(SQL)
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"), size=3, percent=85)
