"""Mixing sources to target weights by nested hash thresholds, without a sort.

Every document has a hash of 60 bits. A source that may take ``t`` words of its
``s`` takes each document ``floor(t / s)`` times, and once more those whose hash
lies below a threshold. The threshold is found on histograms: words summed by
source and by 12 bits of the hash, then by the next 12 bits inside the one
bucket in which the budget ends, and so on. Only that bucket is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.session import settle

# The weights of the sources in order, repeating, and the most often a document is taken.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS, BITS = 5, 12  # 60 bits of hash in five levels of 4096 buckets


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of the id and the text, so that rows which share an id part."""
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(text), F.lit("-")))
    return F.conv(F.substring(F.md5(ident), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)``: the total size shared by weight under the cap of each source.

    ``sizes`` has a row per source. A source is capped if its cap over its
    weight is below the water level, so with the sources in order of that ratio
    the capped ones come first, and the level follows from two running sums.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    named = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    named = named.withColumn("_cap", F.lit(max_repeats) * F.col("source_size"))
    order = W.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    whole, before = W.partitionBy(), order.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        named.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_level", (F.sum("source_size").over(whole) - F.col("_capped")) / F.col("_weights"))
    )
    # Levels rise while sources are capped and fall afterwards, so the one that holds is the largest that fits.
    fits = F.col("_level") * F.col("_weight") <= F.col("_cap")
    water = F.max(F.when(fits, F.col("_level"))).over(whole)
    target = F.least(F.col("_cap").cast("double"), water * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """A row per source: ``source_size``, ``target``, ``_whole`` takes of every document, and the hash
    ``_below`` which one more take is given; ``_also`` tells whether the documents at that hash get it too."""
    sources = settle(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    cuts = sources.withColumn("_whole", whole.cast("long"))
    cuts = cuts.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    cuts = cuts.withColumn("_prefix", F.lit(0).cast("long"))
    up_to = W.partitionBy("source").orderBy("_bucket")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        of = cuts.select(F.col("source").alias("_of"), "_prefix", "_rest")
        inside = sized.join(of, F.col("source").eqNullSafe(F.col("_of")))
        inside = inside.filter(F.shiftright("hash", shift + BITS) == F.col("_prefix")).filter("size > 0")
        counts = inside.groupBy("source", "_rest", F.shiftright("hash", shift).alias("_bucket")).agg(F.sum("size").alias("_words"))
        ends = counts.withColumn("_end", F.sum("_words").over(up_to))
        # The first bucket that ends beyond the budget; none if the budget holds the whole source.
        over = ends.filter(F.col("_end") > F.col("_rest"))
        over = over.withColumn("_turn", F.row_number().over(up_to)).filter("_turn = 1")
        over = over.select(F.col("source").alias("_of"), F.col("_bucket"), (F.col("_end") - F.col("_words")).alias("_used"), "_words")
        joined = cuts.join(over, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
        last = {"_also": 2 * (F.col("_rest") - F.col("_used")) >= F.col("_words")} if level == LEVELS - 1 else {}
        cuts = joined.withColumns(last).withColumns(
            {"_prefix": F.coalesce("_bucket", F.lit(1 << 62)), "_rest": F.col("_rest") - F.coalesce("_used", F.lit(0))}
        )
        cuts = settle(cuts.drop("_bucket", "_used", "_words"), "mix-cuts")
    return cuts.select("source", "source_size", "target", "_whole", F.col("_prefix").alias("_below"), "_also")


def with_repeats(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``repeats``, the takes of each document."""
    renamed = cuts.withColumnRenamed("source", "_of")
    once_more = (F.col("hash") < F.col("_below")) | ((F.col("hash") == F.col("_below")) & F.coalesce("_also", F.lit(False)))
    more = F.when(once_more & (F.col("target") > 0), F.lit(1)).otherwise(F.lit(0))
    joined = sized.join(renamed, F.col("source").eqNullSafe(F.col("_of")))
    full = F.col("_whole") * F.col("source_size") >= F.col("target")
    repeats = F.col("_whole") + F.when(full, F.lit(0)).otherwise(more)
    return joined.withColumn("repeats", repeats.cast("long")).drop("_of", "_whole", "_below", "_also")


def _sized(docs: DataFrame, seed: int) -> list[Column]:
    return [word_count(docs["text"]).alias("size"), document_hash(seed, docs["doc_id"], docs["text"]).alias("hash")]


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; all columns are kept.

    Whole documents are taken, so a source misses its target by at most half of
    the one document at which its budget ends (half of a group of rows, where
    rows are equal in id and text). Null text has size 0; such documents, like
    blank ones, stay as often as their hash says. A null source is a source of its
    own, the last in order. Extra columns may have any name. An empty table
    gives an empty one.
    """
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["source"].alias("source"), *_sized(docs, seed))
    cuts = thresholds(settle(row.select("source", "size", "hash"), "mix-sizes"))
    taken = with_repeats(row, cuts)
    copies = taken.filter("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.select("_row.*")


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; see ``mix`` for the rules."""
    sized = settle(docs.select("doc_id", "source", *_sized(docs, seed)), "mix-sizes")
    taken = with_repeats(sized, thresholds(sized))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')), 1, 15))::BIGINT AS hash
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM named WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(3.0::DOUBLE * source_size, weight * max(CASE WHEN level * weight <= 3 * source_size THEN level END) OVER ()) AS target
  FROM ranked),
cut AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto,
    sum(size) OVER (PARTITION BY d.source, hash) AS here
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN whole * source_size < target AND (upto <= target - whole * source_size
    OR (2 * (target - whole * source_size - (upto - here)) >= here AND upto - here <= target - whole * source_size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cut"""


@query(SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
