"""Secret scans with multipart linking, in built-in functions only.

Strong finds (labelled assignments, access ids, long hexadecimal runs) are always
reported. Weak candidates (names of users, unlabelled tokens, addresses of
services) mean little alone; an interval join over windows of the text reports
them only where the parts that complete them lie near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.session import settle

# The patterns. Kinds stand in the order in which spans of one start are listed.
KEYWORDS = "password|passwd|secret|token|api_?key"
NAMES = "user(?:name)?|login|client_id|account"
SCHEMES = "https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis"
PATTERNS = {
    "assign": rf"""(?i:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",  # whole runs, so the least length may stand in the pattern
    "hex": r"[0-9a-f]{32,}",
    "ident": rf"""(?i:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
    "weak": r"[A-Za-z0-9+/]{40,}",
    "endpoint": rf"""(?:{SCHEMES})://[^\x00-\x20"'<>]+""",
}
# What a text must hold for the pattern to be tried; quick to tell.
HINTS = {
    "assign": rf"(?i){KEYWORDS}",
    "access": r"AKIA",
    "hex": r"[0-9a-f]{32}",
    "ident": rf"(?i){NAMES}",
    "weak": r"[A-Za-z0-9+/]{40}",
    "endpoint": r"://",
}
BASE = ("assign", "access", "hex")
# The class of part that each kind is, and the classes that must lie near for a weak kind to be reported.
CLASSES = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "weak": "secret", "endpoint": "place"}
NEEDS = {"ident": ("secret",), "weak": ("id",), "endpoint": ("id", "secret")}
WINDOW = 200  # code points between the starts of parts that belong together


def _accepted(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 1)) >= 8
    if kind == "ident":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 1)) >= 3
    if kind == "weak":
        mixed = match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
        return (F.length(match) == 40) & mixed
    return F.lit(True)


def _segments(kind: str, text: Column) -> Column:
    """The text as runs that end in a match: the length of each run, of its match, and whether the match counts.

    The last run may have no match; without that the rest of a text would be searched again from each place.
    """
    whole = rf"(?s)(.*?)({PATTERNS[kind]}|\z)"
    runs = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    matches = F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    told = F.zip_with(
        runs,
        matches,
        lambda run, match: F.struct(
            F.length(run).cast("long").alias("run"),
            F.length(match).cast("long").alias("match"),
            ((F.length(match) > 0) & _accepted(kind, match)).alias("ok"),
        ),
    )
    return F.when(text.rlike(HINTS[kind]), told)


def _found(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    columns = [F.struct(F.lit(n).alias("order"), F.lit(kind).alias("kind"), _segments(kind, text).alias("runs")) for n, kind in enumerate(PATTERNS)]
    found = F.filter(F.array(*columns), lambda k: k["runs"].isNotNull())
    return settle(docs.select(docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("_row"), found.alias("found")), "secrets")


def _spans(found: DataFrame) -> DataFrame:
    """``_row, order, kind, start, end`` of all accepted matches, in code points."""
    kinds = found.select("_row", F.explode("found").alias("k")).select("_row", "k.order", "k.kind", F.posexplode("k.runs").alias("at", "r"))
    upto = W.partitionBy("_row", "order").orderBy("at")
    ends = kinds.withColumn("end", F.sum("r.run").over(upto))
    return ends.filter("r.ok").select("_row", "order", "kind", (F.col("end") - F.col("r.match")).alias("start"), "end")


def linked(spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """The weak spans whose complementary parts start within ``window``.

    Windows of the text are bins. A bin is told by the first and last start of
    each class in it, so a span meets three rows per class at most, however many
    parts there are.
    """
    of_class = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    bins = spans.groupBy("_row", of_class[F.col("kind")].alias("class"), F.floor(F.col("start") / window).alias("bin")).agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    needs = F.create_map(*[x for kind, classes in NEEDS.items() for x in (F.lit(kind), F.array(*map(F.lit, classes)))])
    weak = spans.filter(F.col("kind").isin(*NEEDS)).withColumn("need", needs[F.col("kind")])
    home = F.floor(F.col("start") / window)
    probes = weak.withColumn("class", F.explode("need")).withColumn("bin", F.explode(F.array(home - 1, home, home + 1)))
    near = (F.abs(F.col("first") - F.col("start")) <= window) | (F.abs(F.col("last") - F.col("start")) <= window)
    met = probes.join(bins, ["_row", "class", "bin"]).filter(near)
    whole = met.groupBy("_row", "order", "kind", "start", "end").agg(F.count_distinct("class").alias("met"), F.first(F.size("need")).alias("all"))
    return whole.filter(F.col("met") == F.col("all")).drop("met", "all")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row.

    Positions count code points; null text is empty. ``spans`` lists the strong
    finds and the linked weak ones as ``kind:start:end``. Rows that share an id, or have none, are
    scanned each on its own; extra columns are ignored; an empty table gives an empty one.
    """
    found = _found(docs)
    spans = settle(_spans(found), "secrets-spans")
    told = spans.filter(F.col("kind").isin(*BASE)).unionByName(linked(spans, window))
    lists = told.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("_all"))
    rows = found.select("doc_id", "_row").join(lists, "_row", "left")
    every = F.coalesce("_all", F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>"))
    rows = rows.withColumn("_all", every).withColumn("_base", F.filter("_all", lambda s: s["kind"].isin(*BASE)))

    def number(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))


def _sql() -> str:
    """The same by brute force: every weak span against every part of its document."""

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def kind(n: int, name: str) -> str:
        whole, own = quoted(rf"(?s)(.*?)({PATTERNS[name]}|\z)"), quoted(PATTERNS[name])
        least = {"assign": 8, "ident": 3}.get(name)
        ok = f"length(regexp_extract(m, '{own}', 1)) >= {least}" if least else "true"
        if name == "weak":
            ok = "length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
        return f"""
  SELECT doc_id, {n} AS ord, '{name}' AS kind, m, upto - length(m) AS s, upto AS e FROM (
    SELECT doc_id, m, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
      SELECT doc_id, unnest(regexp_extract_all(t, '{whole}', 0)) AS run, unnest(regexp_extract_all(t, '{whole}', 2)) AS m,
        unnest(range(len(regexp_extract_all(t, '{whole}', 0)))) AS i
      FROM d WHERE regexp_matches(t, '{quoted(HINTS[name])}')))
  WHERE length(m) > 0 AND {ok}"""

    parts = " UNION ALL ".join(kind(n, k) for n, k in enumerate(PATTERNS))
    classes = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in CLASSES.items())
    near = "EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.class = '{}' AND abs(c.s - a.s) <= " + str(WINDOW) + ")"
    weak = " OR ".join(f"(kind = '{k}' AND {' AND '.join(near.format(c) for c in need)})" for k, need in NEEDS.items())
    base = "kind IN ('assign', 'access', 'hex')"
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({parts}),
c AS (SELECT *, CASE kind {classes} END AS class FROM p),
told AS (SELECT * FROM c a WHERE {base} OR {weak})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce({text} FILTER ({base}), '')) AS base_sha256, coalesce({text}, '') AS spans
FROM d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id"""


@query(_sql())
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
