"""Near-duplicate lines by a deletion-neighbourhood join, in built-in functions only.

Edits are whole words; the bound is one: a word changed, added or left out. Two
lines within it have equal hashes among those of themselves and of what is left
when one word is deleted. Lines are folded by digest first. Only lines that
share their first or last words with another one, as any two within the bound
do, emit their variants; a variant meets the earliest line of its key alone, so
no group gives all its pairs; and every match is confirmed on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.session import release, settle, sieve

MIN_WORDS = 5  # of a line that is compared by edits, of which one word is a fifth: such lines are alike to 0.8 at least
LINE_BITS = 4294967296  # lines of a document have numbers below this
USUAL_WORDS = 2048  # of a line whose variants are made within its row
POSITIONS = 512  # places of removed lines held together

SPACES = r"[\x20\x09-\x0D]+"


def normal(line: Column) -> Column:
    """Words parted by one space, without space at the ends; most lines are so but for their ends."""
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c", "\n"):
        odd = odd | F.contains(line, F.lit(mark))
    return F.when(odd, F.trim(F.regexp_replace(line, SPACES, " "))).otherwise(F.trim(line))


def _words(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def line_digest(norm: Column) -> Column:
    """Null for a blank line."""
    return F.when(norm != "", F.unhex(F.md5(norm)))


def _order(doc_id: Column, pos: Column) -> Column:
    """The place of a line in the corpus as one number."""
    return (doc_id.cast("decimal(20,0)") * F.lit(LINE_BITS).cast("decimal(10,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, pos, norm, digest`` of every line that is not blank, in documents with an id."""
    lines = F.posexplode(F.split(docs["text"], "\n")).alias("pos", "line")
    rows = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), *more, lines)
    rows = rows.select("doc_id", "pos", *more, normal(F.col("line")).alias("norm"))
    return rows.withColumn("digest", line_digest(F.col("norm"))).filter("digest is not null")


def _half(n: Column) -> Column:
    """A power of two, no more than half of ``n``: few lengths change it."""
    return F.pow(F.lit(2.0), F.length(F.bin(n)) - 2).cast("int")


def _ends(norm: Column, own: Column, other: Column) -> list[Column]:
    """Hashes of the first and of the last words, of as many as a half; of two halves, where a line one word shorter has another."""

    def end(half: Column, last: bool) -> Column:
        return F.xxhash64(F.lit(last), half, F.call_function("substring_index", norm, F.lit(" "), -half if last else half))

    return [end(own, False), end(own, True), F.when(own != other, end(other, False)), F.when(own != other, end(other, True))]


def _told(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_lines, pos, digest, k0..k3``, stored: the lines that are not blank, and the first line of every row.

    Short lines have no ends: they are told apart by their digests alone. All that later steps ask of a line but its words is here, so the texts are gone through once.
    """
    split = F.split(docs["text"], "\n")
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), n_lines, split.alias("_lines"))
    rows = rows.select("row", "doc_id", "n_lines", F.posexplode_outer("_lines").alias("pos", "line"))
    rows = rows.withColumn("norm", normal(F.col("line")))
    rows = rows.withColumn("digest", F.when(F.col("doc_id").isNotNull(), line_digest(F.col("norm"))))
    rows = rows.filter("digest is not null or pos = 0 or pos is null")
    # Halves are columns of their own, so that each is worked out once a line; null for short lines, whose ends then are none.
    rows = rows.withColumn("_n", F.when(F.col("digest").isNotNull(), _words(F.col("norm"))))
    long = F.col("_n") >= MIN_WORDS
    rows = rows.withColumns({"_own": F.when(long, _half(F.col("_n"))), "_other": F.when(long, _half(F.col("_n") - 1))})
    ends = [F.when(F.col("_own").isNotNull(), k).alias(f"k{i}") for i, k in enumerate(_ends(F.col("norm"), F.col("_own"), F.col("_other")))]
    return settle(rows.select("row", "doc_id", "n_lines", "pos", "digest", *ends), "lines-told")


def _active(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``digest, first, many`` of every distinct line, and ``digest, first, by_first, by_last`` of those that share an end."""
    lines = told.filter("digest is not null").withColumn("at", _order(F.col("doc_id"), F.col("pos")))
    # The keys are those of the line, whichever row tells them.
    folded = lines.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("many"), *[F.min(f"k{k}").alias(f"k{k}") for k in range(4)])
    folded = settle(folded, "lines")
    release(told.sparkSession)
    pairs = F.array(*[F.struct(F.col(f"k{k}").alias("key"), F.lit(k % 2 == 1).alias("last")) for k in range(4)])
    keys = folded.select("digest", "first", F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("e"))
    keys = keys.select("digest", "first", "e.key", "e.last")
    common = settle(keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").select("_key"), "lines-ends")
    release(told.sparkSession)
    met = sieve(keys, F.col("key"), common, F.col("_key")).join(common, F.col("key") == F.col("_key"))
    sides = met.groupBy("digest").agg(F.min("first").alias("first"), F.max(~F.col("last")).alias("by_first"), F.max("last").alias("by_last"))
    return folded.select("digest", "first", "many"), settle(sides, "lines-active")


def _texts(docs: DataFrame, active: DataFrame) -> DataFrame:
    """``digest, at, norm, by_first, by_last`` of the active lines, each read where it stands first."""
    size = F.lit(LINE_BITS).cast("decimal(10,0)")
    pos = F.pmod("first", size)
    wanted = active.select(((F.col("first") - pos) / size).cast("long").alias("doc_id"), pos.cast("int").alias("pos"), "digest")
    held = settle(_held(wanted), "lines-wanted")
    release(docs.sparkSession)
    # Few documents have such a line, and the texts of the others stay where they are.
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = sieve(rows, F.col("doc_id"), held, F.col("_doc"))
    # The lists grow with the documents, so they are not broadcast while they happen to be small.
    own = _lines(rows.join(held.hint("merge"), F.col("doc_id") == F.col("_doc")), "_gone").filter(_is_gone(F.col("pos"), F.col("digest")))
    own = own.select("digest", "norm", _order(F.col("doc_id"), F.col("pos")).alias("at"))
    sides = active.select(F.col("digest").alias("_digest"), "by_first", "by_last")
    found = own.distinct().join(sides, F.col("digest") == F.col("_digest"))
    return settle(found.drop("_digest"), "lines-texts")


SUMS = {"key": (), "more": ("more",)}  # what is hashed besides the word: two sums that do not depend on each other


def _word_hash(sum_: str, word: Column, place: Column) -> Column:
    """40 bits per word and number, so that sums stay in range; a key of two sums has above 80."""
    return F.shiftrightunsigned(F.xxhash64(word, place, *[F.lit(x) for x in SUMS[sum_]]), 24)


def _short_variants(texts: DataFrame) -> DataFrame:
    """Of lines of usual length: the running sums are arrays of the row."""

    def sums(values: Column) -> Column:
        last = lambda acc: F.element_at(acc, -1)
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    words = F.split("norm", " ")

    def hashes(sum_: str, shift: int) -> Column:
        return sums(F.transform(words, lambda word, p: _word_hash(sum_, word, p - shift)))

    rows = texts.withColumns({f"{name}_{x}": hashes(x, shift) for x in SUMS for name, shift in (("stays", 0), ("moves", 1))})

    def key(x: str, p: Column) -> Column:
        # Sums stand at one place more than the word they end with, as they begin with nothing.
        one = F.get(f"stays_{x}", p - 1) + F.element_at(f"moves_{x}", -1) - F.get(f"moves_{x}", p)
        return F.when(p == 0, F.element_at(f"stays_{x}", -1)).otherwise(one).alias(x)

    places = F.filter(F.sequence(F.lit(0), F.col("n")), lambda p: (p == 0) | _open(p))
    given = F.transform(places, lambda p: F.struct(p.alias("place"), *[key(x, p) for x in SUMS]))
    return rows.select("digest", "at", F.explode(given).alias("v")).select("digest", "at", "v.place", *[f"v.{x}" for x in SUMS])


def _long_variants(texts: DataFrame) -> DataFrame:
    """Of lines of any length: a row per word, and sums over windows."""
    rows = texts.select("digest", "at", "by_first", "by_last", "n", F.posexplode(F.split("norm", " ")).alias("p", "word"))
    hashed = {f"{name}_{x}": _word_hash(x, F.col("word"), F.col("p") - shift) for x in SUMS for name, shift in (("stays", 0), ("moves", 1))}
    rows = rows.withColumns(hashed | {"place": F.col("p") + 1})
    line = W.partitionBy("digest", "at")
    upto = line.orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = {f"left_{x}": F.sum(f"stays_{x}").over(upto) - F.col(f"stays_{x}") for x in SUMS}
    right = {f"right_{x}": F.sum(f"moves_{x}").over(line) - F.sum(f"moves_{x}").over(upto) for x in SUMS}
    rows = rows.withColumns(left | right)
    one = F.struct(F.col("place").alias("place"), *[(F.col(f"left_{x}") + F.col(f"right_{x}")).alias(x) for x in SUMS])
    whole = F.struct(F.lit(0).alias("place"), *[(F.col(f"left_{x}") + F.col(f"stays_{x}")).alias(x) for x in SUMS])
    given = F.filter(F.array(F.when(_open(F.col("place")), one), F.when(F.col("place") == F.col("n"), whole)), lambda v: v.isNotNull())
    return rows.select("digest", "at", F.explode(given).alias("v")).select("digest", "at", "v.place", *[f"v.{x}" for x in SUMS])


def _open(place: Column) -> Column:
    """Where the edit may be: a shared beginning leaves it behind, a shared end ahead."""
    half = _half(F.col("n") - 1)
    return (F.col("by_first") & (place > half)) | (F.col("by_last") & (place <= F.col("n") - half))


def _variants(texts: DataFrame) -> DataFrame:
    """``digest, at, place, key, more``: two hashes of every line without the word at ``place``, and of the whole line at place 0.

    Words are hashed with their number, so a variant's hash is a sum of two running
    sums, the same whichever way they are made. A key keeps one line alone, so
    lines that are not alike may not share it: both hashes together are the key.
    """
    sized = texts.withColumn("n", _words(F.col("norm")).cast("int"))
    return _short_variants(sized.filter(F.col("n") <= USUAL_WORDS)).unionByName(_long_variants(sized.filter(F.col("n") > USUAL_WORDS)))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two lists of words differ by one word changed, added or left out at most."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False).cast("int")  # from 1; 0 if none differs
    n, m = F.size(a), F.size(b)

    def rest(words: Column, at: Column) -> Column:
        return F.slice(words, at, F.greatest(F.size(words) - at + 1, F.lit(0)))

    changed = (n == m) & (rest(a, first + 1) == rest(b, first + 1))
    longer = (n == m + 1) & (rest(a, first + 1) == rest(b, first))
    shorter = (n + 1 == m) & (rest(a, first) == rest(b, first + 1))
    return (first == 0) | changed | longer | shorter


def near_lines(docs: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct lines (``digest, first, many``) and those (``digest``) near a line that stands earlier."""
    spark = docs.sparkSession
    lines, active = _active(told)
    release(spark)
    texts = _texts(docs, active)
    variants = settle(_variants(texts), "lines-variants")
    release(spark)
    whole = F.min(F.when(F.col("place") == 0, F.col("at")))
    less = F.min(F.when(F.col("place") > 0, F.col("at")))
    shared = variants.groupBy(*SUMS).agg(F.count("*").alias("n"), whole.alias("whole"), less.alias("less")).filter("n > 1")
    shared = settle(shared.select(*[F.col(x).alias(f"_{x}") for x in SUMS], "whole", "less"), "lines-shared")
    release(spark)
    same = (F.col("key") == F.col("_key")) & (F.col("more") == F.col("_more"))
    met = settle(sieve(variants, F.col("key"), shared, F.col("_key")).join(shared, same).drop("_key", "_more"), "lines-met")
    # Of equal length and with the same word left out: one word changed.
    changed = settle(met.filter("place > 0").groupBy(*SUMS, "place").agg(F.min("at").alias("changed")), "lines-changed")
    changed = changed.select(*[F.col(x).alias(f"_{x}") for x in SUMS], F.col("place").alias("_place"), "changed")
    met = met.join(changed, same & (F.col("place") == F.col("_place")), "left")
    partners = F.when(F.col("place") == 0, F.array("less")).otherwise(F.array("whole", "changed"))
    pairs = met.select("digest", "at", F.explode(partners).alias("earlier")).filter("earlier < at").distinct()
    pairs = settle(pairs, "lines-pairs")
    release(spark)
    own = sieve(texts.select(F.col("digest").alias("_digest"), F.col("norm").alias("own")), F.col("_digest"), pairs, F.col("digest"))
    other = sieve(texts.select(F.col("at").alias("_at"), F.col("norm").alias("other")), F.col("_at"), pairs, F.col("earlier"))
    both = settle(pairs.join(own, F.col("digest") == F.col("_digest")).drop("_digest"), "lines-both")
    both = both.join(other, F.col("earlier") == F.col("_at")).filter(_within_one(F.split("own", " "), F.split("other", " ")))
    near = settle(both.select("digest").distinct(), "lines-near")
    release(spark)
    return lines, near


def removed_lines(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``row, doc_id, pos, digest`` of every line that goes, stored."""
    lines, near = near_lines(docs, told)
    # Lines that stand once and are near none need not be met.
    some = lines.filter("many > 1").unionByName(sieve(lines.filter("many = 1"), F.col("digest"), near, F.col("digest")))
    marked = some.join(near.withColumn("near", F.lit(True)), "digest", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    marked = settle(marked.filter("many > 1 or near").select(F.col("digest").alias("_digest"), "first", "near"), "lines-marked")
    release(docs.sparkSession)
    every = told.filter("digest is not null").select("row", "doc_id", "pos", "digest")
    every = sieve(every, F.col("digest"), marked, F.col("_digest"))
    gone = every.join(marked, F.col("digest") == F.col("_digest")).filter(F.col("near") | (_order(F.col("doc_id"), F.col("pos")) > F.col("first")))
    return settle(gone.select("row", "doc_id", "pos", "digest"), "lines-gone")


def _held(gone: DataFrame) -> DataFrame:
    """``_doc, _gone``: by document a map from a range of places to what is removed there; as long as the document at most."""
    ranges = gone.groupBy("doc_id", F.floor(F.col("pos") / POSITIONS).cast("int").alias("range")).agg(F.collect_set(F.struct("pos", "digest")).alias("those"))
    return ranges.groupBy(F.col("doc_id").alias("_doc")).agg(F.map_from_entries(F.collect_list(F.struct("range", "those"))).alias("_gone"))


def _is_gone(pos: Column, digest: Column) -> Column:
    those = F.col("_gone")[F.floor(pos / POSITIONS).cast("int")]
    return F.coalesce(F.array_contains(those, F.struct(pos.alias("pos"), digest.alias("digest"))), F.lit(False))


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for every row; ``removed`` lists the numbers of its lines that go, from 0.

    A line goes if an equal line stands earlier, or, where both have five words or more, one that differs by
    one word: in a document of smaller id, or before it in its own. Lines are
    judged as they came, not by what is left. White space within a line does
    not count. Blank lines stay, as does all in rows with a null id, which
    other lines are not compared with either. Rows that share an id share their
    places: a line at the same place is not earlier. Null text has no lines, an empty one has one. Extra columns are
    ignored; an empty table gives an empty one.
    """
    told = _told(docs)
    gone = removed_lines(docs, told).groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list("pos")).alias("_gone"))
    rows = told.filter("pos = 0 or pos is null").select("row", "doc_id", "n_lines").join(settle(gone, "lines-held"), F.col("row") == F.col("_row"), "left")
    numbers = F.array_join(F.transform("_gone", lambda p: p.cast("string")), ",")
    n_removed = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_lines", n_removed.alias("n_removed"), F.coalesce(numbers, F.lit("")).alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without those lines; a document that loses all words it had goes. All columns are kept.

    ``n_chars``, where there is such a column, is the length of the new text.
    """
    held = settle(_held(removed_lines(docs, _told(docs)).select("doc_id", "pos", "digest").distinct()), "lines-held")
    fresh = {c: docs[c].alias(c) for c in docs.columns}
    row = docs.select(F.struct(*fresh.values()).alias("_row"))
    told = row.join(held.hint("merge"), F.col("_row.doc_id") == F.col("_doc"), "left")
    lines = F.split(F.col("_row.text"), "\n")
    left = F.array_join(F.filter(lines, lambda line, pos: ~_is_gone(pos, line_digest(normal(line)))), "\n")
    told = told.withColumn("_text", F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(left))
    told = told.filter(F.col("_gone").isNull() | (normal(F.col("_text")) != "") | (normal(F.col("_row.text")) == ""))
    row_of = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row_of["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_row")["n_chars"]).otherwise(F.length("_text").cast(kind))
    return told.select(*[v.alias(c) for c, v in row_of.items()])


SQL = r"""
WITH raw AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
norm AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM raw),
lines AS (SELECT doc_id, pos, t, string_split(t, ' ') AS w FROM norm WHERE t <> ''),
firsts AS (SELECT t, any_value(w) AS w, min((doc_id, pos)) AS o FROM lines GROUP BY t),
long AS (SELECT * FROM firsts WHERE len(w) >= 5),
variants AS (SELECT t, o, len(w) AS n, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM long)),
changed AS (SELECT t, o, min(o) OVER (PARTITION BY v, i) AS e FROM variants),
longer AS (SELECT v.t AS t, v.o AS o, f.o AS e FROM variants v JOIN long f ON v.v = f.t),
near AS (SELECT DISTINCT t FROM (SELECT * FROM changed UNION ALL SELECT * FROM longer UNION ALL
  SELECT f.t, f.o, v.o FROM variants v JOIN long f ON v.v = f.t) WHERE e < o),
gone AS (SELECT doc_id, pos FROM lines JOIN firsts USING (t) LEFT JOIN near n USING (t) WHERE n.t IS NOT NULL OR (doc_id, pos) > o)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
  coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos), '') AS removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id GROUP BY d.doc_id, d.text"""


@query(SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
