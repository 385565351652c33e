"""Reproducible samples and shuffles.

The random order is that of ``md5(seed:id)``, with the id as the tie-breaker, so
it does not depend on how the data is partitioned and any SQL engine can repeat
it. The leading hex digits of the digest cut each group into equal buckets. A
cheap first aggregate counts the buckets; the counts then tell which buckets are
needed and at which position each one starts. No sort ever covers a whole group,
so a group holding a third of all rows is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from codepairs.functions.text import backticked
from codepairs.operators.records import melt_by_type, split_by_label
from codepairs.session import bounded_broadcast, settle

# 16**4 = 65 536 buckets per group: 10**11 rows make buckets of 1.5 million rows.
BUCKET_DIGITS = 4


def random_key(*parts: Column | int | str) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts))


def _with_key(df: DataFrame, key: Column, digits: int) -> DataFrame:
    return df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))


def _bucket_starts(keyed: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, _bucket, _count, _start)``: at most 16**digits rows per group, so the window is small."""
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    return counts.withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0)))


def sample_per_group(
    df: DataFrame,
    group: str,
    groups: Sequence,
    k: int | None,
    id_col: str,
    seed: int = 42,
    strict: bool = True,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """``k`` rows without replacement from each of ``groups``; all their rows if ``k`` is None or 0.

    The buckets before the one in which row ``k`` falls belong to the sample
    whole; only that one is ranked, on ids alone, so no task sorts ``k`` rows
    however large ``k`` is. ``strict`` makes a short group an error. Rows that
    share an id are rows of their own; of those the cut falls among, some are taken by a digest of the whole row.
    """
    wanted = df.filter(backticked(group).isin(list(groups)))
    if not k:
        return wanted
    keyed = _with_key(wanted, random_key(seed, backticked(id_col)), digits)
    starts = _bucket_starts(_with_key(wanted.select(group, id_col), random_key(seed, backticked(id_col)), digits), [group])
    last = F.struct("_bucket", "_start")
    cut = starts.groupBy(group).agg(F.max(F.when(F.col("_start") < k, last)).alias("_cut"), F.sum("_count").alias("_n"))
    if strict:
        names = F.array(*[F.lit(g) for g in groups]).cast(T.ArrayType(df.schema[group].dataType))
        every = df.sparkSession.range(1).select(F.explode(names).alias(group))
        short = F.raise_error(F.concat(F.lit("too few rows to sample in group "), backticked(group).cast("string")))
        enough = F.coalesce(F.col("_n"), F.lit(0)) >= k
        cut = every.join(cut, group, "left").select(group, F.when(enough, F.col("_cut")).otherwise(short).alias("_cut"))
    cut = bounded_broadcast(cut.select(group, "_cut"), len(groups))
    near = keyed.join(cut, group).filter(F.col("_bucket") <= F.col("_cut._bucket"))
    # The rank inside the cut bucket, told by the key of the last row that is taken.
    ranked = _with_key(wanted.select(group, id_col), random_key(seed, backticked(id_col)), digits)
    ranked = ranked.join(cut, group).filter(F.col("_bucket") == F.col("_cut._bucket"))
    order = W.partitionBy(group, "_bucket").orderBy("_key", id_col)
    equal = F.count("*").over(W.partitionBy(group, "_bucket", "_key", id_col))
    ranked = ranked.withColumns({"_rank": F.row_number().over(order), "_first": F.rank().over(order), "_equal": equal})
    taken = ranked.filter(F.col("_rank") <= k - F.col("_cut._start"))
    told = F.struct((k - F.col("_cut._start") - F.col("_first") + 1).alias("due"), F.col("_equal").alias("equal"))
    last = taken.groupBy(group).agg(F.max(F.struct("_key", id_col)).alias("_last"), F.max_by(told, F.struct("_key", id_col)).alias("_told"))
    last = settle(last, "sample-last")  # a row per group
    near = near.join(bounded_broadcast(last, len(groups)), group, "left")
    here = F.struct("_key", id_col)
    whole = F.col("_bucket") < F.col("_cut._bucket")
    if last.filter("_told.equal > _told.due").isEmpty():
        return near.filter(whole | (here <= F.col("_last"))).select(*df.columns)
    # Rows share the last id: some of them, by the digest of the whole row.
    tied = near.filter(~whole & (here == F.col("_last")))
    nth = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(*[backticked(c) for c in df.columns])))
    tied = tied.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_told.due"))
    return near.filter(whole | (here < F.col("_last"))).select(*df.columns).unionByName(tied.select(*df.columns))


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42, strict: bool = True, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``n`` rows without replacement; under ``strict`` it is an error if there are fewer."""
    # One group, under a key that the optimizer can not fold into a join without one.
    whole = df.withColumn("_all", F.pmod(F.xxhash64(backticked(id_col)), F.lit(1).cast("bigint")))
    return sample_per_group(whole, "_all", [0], n, id_col, seed, strict, digits).drop("_all")


def seeded_shuffle(
    df: DataFrame, id_col: str, batch: int, seed: int = 42, epoch: int = 0, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """A shuffled ``position`` over all rows and the ``batch_id`` it falls into.

    Rows are ranked inside their bucket only; the start of each bucket comes from
    a table of at most 16**digits rows.
    """
    key = random_key(seed, epoch, backticked(id_col))
    starts = _bucket_starts(_with_key(df.select(id_col), key, digits), []).select("_bucket", "_start")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", id_col))
    placed = _with_key(df, key, digits).join(bounded_broadcast(starts, 16**digits), "_bucket")
    position = (F.col("_start") + rank - 1).cast("bigint")
    return placed.withColumn("position", position).select(
        *df.columns, "position", F.expr(f"position div {int(batch)}").alias("batch_id")
    )


def balanced_sample(
    df: DataFrame,
    node_types: Sequence[str],
    use_size: int,
    id_col: str,
    text_col: str = "text",
    seed: int = 42,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Equal numbers of positives and negatives per node type, drawn with replacement.

    ``half = min(positives, negatives, use_size div 2)``; the output holds
    ``(node_type, idx, sentence, label)`` with ``idx`` counted anew in each class.

    All node types share one pass that counts buckets. Draws are positions in a
    class; only the buckets that hold a drawn position are ranked, on ids alone,
    and the text is fetched for drawn ids only.
    """
    long = split_by_label(melt_by_type(df, node_types, [id_col]))
    keyed = _with_key(long, random_key(seed, backticked(id_col)), digits)
    cls = ["node_type", "label"]
    starts = settle(_bucket_starts(keyed, cls), "bucket-starts")

    sizes = starts.groupBy(*cls).agg(F.sum("_count").alias("_n"))
    half = (
        sizes.groupBy("node_type")
        .agg(F.least(F.min("_n"), F.lit(int(use_size) // 2)).alias("_half"), F.count("*").alias("_classes"))
        .filter("_classes = 2 AND _half > 0")
    )
    draws = (
        sizes.join(bounded_broadcast(half, len(node_types)), "node_type")
        .select(*cls, "_n", F.explode(F.expr("sequence(0, cast(_half AS int) - 1)")).alias("idx"))
        .withColumn("_digest", random_key(seed, F.col("node_type"), F.col("label"), F.col("idx")))
        .withColumn("_pos", F.conv(F.substring("_digest", 1, 15), 16, 10).cast("bigint") % F.col("_n"))
        .select(*cls, "idx", "_pos")
    )

    # The bucket of a drawn position is the last one that starts at or before it.
    marks = starts.select(*cls, F.lit(None).cast("int").alias("idx"), F.col("_start").alias("_pos"), "_bucket", "_start")
    points = draws.select("*", F.lit(None).cast("string").alias("_bucket"), F.lit(None).cast("bigint").alias("_start"))
    so_far = W.partitionBy(*cls).orderBy("_pos", F.col("idx").asc_nulls_first())
    drawn = (
        marks.unionByName(points)
        .withColumn("_bucket", F.last("_bucket", ignorenulls=True).over(so_far))
        .withColumn("_start", F.last("_start", ignorenulls=True).over(so_far))
        .filter("idx IS NOT NULL")
        .select(*cls, "idx", "_bucket", (F.col("_pos") - F.col("_start")).alias("_place"))
    )
    drawn = settle(drawn, "draws")
    most = 2 * len(node_types) * (int(use_size) // 2)

    needed = bounded_broadcast(drawn.select(*cls, "_bucket").distinct(), most)
    place = F.row_number().over(W.partitionBy(*cls, "_bucket").orderBy("_key", id_col)) - 1
    pool = keyed.join(needed, [*cls, "_bucket"], "left_semi").withColumn("_place", place)
    picked = pool.join(bounded_broadcast(drawn, most), [*cls, "_bucket", "_place"]).select(*cls, "idx", id_col)
    texts = df.select(id_col, F.col(text_col).alias("sentence"))
    return texts.join(bounded_broadcast(picked, most), id_col).select("node_type", "idx", "sentence", "label")
