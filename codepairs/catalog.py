"""Every operator as a named query over the driver tables.

Each query reads whole tables. Where an operator works on inputs that the tables
lack (AST types, edits, model paths), the query derives them from the tables in
Spark; ``FIXTURES.md`` lists the stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.functions import labels as L
from codepairs.functions import text as X
from codepairs.operators import clustering, hierarchy, metrics, models, records, reduction, sampling, similarity, training, vectors, windowed
from codepairs.plans import diff_metric, embedding, subtree
from codepairs.session import scratch_path
from codepairs.sources import readers, schemas, tree, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LABELS = ("quality", "toxic")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_TARGETS, EVENT_STOPS = ("click", "view"), ("error",)
PRUNING_TYPES = ("rule_point", "back_seq", "front_seq", "all_point")
CLUSTER_COSINE, CLUSTER_MIN_PTS = 0.4, 3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


def exploded(df: DataFrame, key: str, **arrays: str) -> DataFrame:
    """One row per position of parallel arrays, values rounded; those of a NULL array are NULL."""
    names = list(arrays)
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array()).alias(n) for n, c in arrays.items()])
    rows = df.select(key, F.posexplode(zipped).alias("dim", "_v"))
    return rows.select(key, "dim", *[rounded(F.col("_v")[n].cast("double")).alias(n) for n in names])


# -- derived inputs -------------------------------------------------------------


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")


def disjoint_halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three quarters for training and the rest for validation, by a digest of the id."""
    part = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    return rows.filter(part < "c"), rows.filter(part >= "c")


def predicted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Both labels predicted by one rule: the stripped text is longer than 500 characters."""
    rows = labelled_documents(spark, sf)
    long_text = (F.length(X.strip_comments(F.col("text"))) > 500).cast("int")
    return rows.withColumns({f"{t}-inference": long_text for t in LABELS})


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """One synthetic edit per user and day: the first event is what was deleted.

    Events are first reduced to one row per type, so a busy user brings five rows
    at most to the second step.
    """
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "ts", "event_id")
    per_type = events.groupBy("user_id", "day", "event_type").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first")
    )
    days = per_type.groupBy("user_id", "day").agg(
        F.collect_list(F.struct("event_type", "n")).alias("types"), F.min_by("event_type", "first").alias("delete_target_node")
    )
    kept = F.filter("types", lambda t: (t["n"] > 1) | (t["event_type"] != F.col("delete_target_node")))
    return days.select(
        "user_id",
        "day",
        F.concat_ws(":", "user_id", "day").alias("original_code"),
        F.concat_ws("-", "user_id", "day").alias("edited_code"),
        "delete_target_node",
        F.array_sort(F.transform("types", lambda t: t["event_type"])).alias("original_ast_node_types"),
        F.array_sort(F.transform(kept, lambda t: t["event_type"])).alias("edited_ast_node_types"),
    )


def long_labels(spark: SparkSession, sf: str) -> DataFrame:
    return records.melt_by_type(table(spark, sf, "labels"), LABELS, ["doc_id"])


def model_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A model path per labelled document, its poolers switched on by the row's own values."""
    rows = labelled_documents(spark, sf)
    name = X.pooler_name(F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") > 1000)
    path = F.concat_ws("_", F.lit("output/base"), name, "source", "doc_id")
    return rows.select("doc_id", "lang", "source", name.alias("pooler"), path.alias("path"))


def document_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Text against stripped text, labelled by the share of characters kept."""
    docs = documents(spark, sf)
    stripped = X.strip_comments(F.col("text"))
    share = F.round(F.length(stripped) / F.length("text"), 6)
    number = F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("bigint") % len(PRUNING_TYPES)
    kind = F.get(F.array(*[F.lit(p) for p in PRUNING_TYPES]), number.cast("int"))
    return docs.select(
        "doc_id", "lang", "source", F.col("text").alias("cleaned_code"), stripped.alias("edited_code"),
        share.alias("cos_sim_diff_char"), (share - 1).alias("cos_sim_diff_node"), kind.alias("pruning_type"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    chats = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), "turn", "role", F.col("text").alias("code"))
    return models.token_counts(chats, "code")


def pooled(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 5").alias("doc"), (F.col("vec_id") % 5).alias("pos"), "embedding"
    )
    return vectors.pool_vectors(rows, "doc", "pos", "embedding")


def nested_edits(spark: SparkSession, sf: str) -> DataFrame:
    """One edit per line of a document; edit number i deletes i + 1 of the nodes."""
    lines = F.split("text", "\n")
    edits = F.transform(lines, lambda line, i: F.struct(line.alias("code"), (i + 1).cast("bigint").alias("count")))
    return documents(spark, sf).select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").alias("original_code"),
        F.size(lines).cast("bigint").alias("num_of_nodes"),
        edits.alias("edited_code"),
    )


def languages(docs: DataFrame) -> list[str]:
    """Language names; null is none."""
    return sorted(r[0] for r in docs.select("lang").distinct().collect() if r[0] is not None)


def store_by_source(spark: SparkSession, sf: str) -> str:
    """Documents as one file per language and source, in the order of their ids."""
    root = scratch_path(spark, "files")
    docs = table(spark, sf, "documents").repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id")
    docs.select("doc_id", "n_chars", "text", "lang", "source").write.partitionBy("lang", "source").json(root)
    return root


def store_nested(items: DataFrame, root: str, per_file: int = 500) -> None:
    """Objects as JSON arrays, some hundred to a file."""
    files = max(1, -(-items.count() // per_file))
    bunches = items.groupBy(F.pmod(F.xxhash64("filename"), F.lit(files)).alias("bunch"))
    arrays = bunches.agg(F.to_json(F.collect_list(F.struct(*items.columns))).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(f"{root}/programs.json")


# -- sources and sinks ----------------------------------------------------------

DOCUMENT = schemas.fields(doc_id=T.LongType(), text=T.StringType(), source=T.StringType(), n_chars=T.LongType())
DOCUMENT_HIVE = T.StructType([*DOCUMENT.fields, T.StructField("lang", T.StringType()), T.StructField("partition", T.StringType())])


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("n_chars") >= 1000, "train").otherwise("test")
    return table(spark, sf, "documents").withColumn("partition", part)


@query
def read_jsonl_partitions(spark: SparkSession, sf: str) -> DataFrame:
    docs = split_documents(spark, sf)
    root = scratch_path(spark, "tree")
    tree.write_jsonl_files(docs, root)
    return readers.read_jsonl_partitions(spark, root, DOCUMENT)


@query
def read_pair_tree(spark: SparkSession, sf: str) -> DataFrame:
    pairs = document_pairs(spark, sf).withColumn("partition", F.lit("train"))
    root = scratch_path(spark, "pair-tree")
    tree.write_jsonl_files(pairs.drop("source", "cos_sim_diff_node"), root, ("lang", "partition", "pruning_type"), leaf="programs", gzipped=True)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *schemas.CHAR_PAIR.fields])
    return readers.read_pair_tree(spark, root, schema)


@query
def read_jsonl_dir(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumns({"set": F.lit("corpus"), "partition": F.lit("test"), "part": F.col("lang")})
    root = scratch_path(spark, "dir")
    tree.write_jsonl_files(docs, root, ("set", "partition", "part"))
    return readers.read_jsonl_dir(spark, root, "corpus", "test", T.StructType([*DOCUMENT.fields, T.StructField("lang", T.StringType())]))


@query
def read_jsonl_file(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumns({"set": F.lit("corpus"), "partition": F.lit("test")})
    root = scratch_path(spark, "file")
    tree.write_jsonl_files(docs, root, ("set", "partition"))
    return readers.read_jsonl_file(spark, root, "corpus", "test", T.StructType([*DOCUMENT.fields, T.StructField("lang", T.StringType())]))


@query
def read_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n")
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("filename"),
        F.col("text").alias("original_code"),
        F.length("text").cast("bigint").alias("num_of_nodes"),
        F.transform(lines, lambda line: F.struct(line.alias("code"), F.length(line).cast("bigint").alias("count"))).alias("edited_code"),
    )
    root = scratch_path(spark, "nested")
    store_nested(items, root)
    rows = readers.read_nested_json(spark, root)
    return rows.select(
        "filename", "original_code", "num_of_nodes", F.size("edited_code").cast("bigint").alias("n_edits"),
        F.array_join(F.transform("edited_code", lambda e: e["code"]), "|").alias("edits"),
    )


@query
def read_jsonl_partitions_some(spark: SparkSession, sf: str) -> DataFrame:
    """Of all languages and partitions on disk, two languages and one partition."""
    docs = split_documents(spark, sf)
    root = scratch_path(spark, "tree")
    tree.write_jsonl_files(docs, root)
    return readers.read_jsonl_partitions(spark, root, DOCUMENT, langs=["en", "fr"], partitions=["train"])


@query
def read_jsonl_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tree by its data source, null names among the others."""
    root = scratch_path(spark, "tree")
    tree.write_jsonl_files(split_documents(spark, sf), root)
    return tree.read_jsonl_tree(spark, root, DOCUMENT)


@query
def read_jsonl_tree_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Filters on the path columns decide which files are opened."""
    root = scratch_path(spark, "tree")
    tree.write_jsonl_files(split_documents(spark, sf), root)
    rows = tree.read_jsonl_tree(spark, root, DOCUMENT)
    return rows.filter("lang IN ('en', 'fr') AND partition = 'train' AND n_chars > 2000")


@query
def read_pair_tree_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """One language and the pruning types that run over sequences, of a tree of three levels."""
    pairs = document_pairs(spark, sf).withColumn("partition", F.lit("train"))
    root, levels = scratch_path(spark, "pair-tree"), ("lang", "partition", "pruning_type")
    tree.write_jsonl_files(pairs.select("doc_id", "cleaned_code", "edited_code", "cos_sim_diff_char", *levels), root, levels, gzipped=True)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *schemas.CHAR_PAIR.fields])
    return tree.read_jsonl_tree(spark, root, schema, levels).filter("lang = 'en' AND pruning_type LIKE '%_seq'")


@query
def tree_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per directory as the write counted them."""
    root = scratch_path(spark, "tree")
    tree.write_jsonl_files(split_documents(spark, sf), root)
    return tree.tree_sizes(spark, root).select("lang", "partition", F.col("rows").alias("n"))


@query
def first_record_per_file_read(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of every file: documents stored one file per language and source, in the order of their ids."""
    root = store_by_source(spark, sf)
    schema = schemas.fields(doc_id=T.LongType(), n_chars=T.LongType(), text=T.StringType())
    return readers.first_record_per_file(spark, f"{root}/*/*/*", schema).drop("file")


@query
def read_selected_file(spark: SparkSession, sf: str) -> DataFrame:
    """Of the files whose first record fits the limits that with most tokens, read alone."""
    root = store_by_source(spark, sf)
    schema = schemas.fields(doc_id=T.LongType(), n_chars=T.LongType(), text=T.StringType())
    first = models.token_counts(readers.first_record_per_file(spark, f"{root}/*/*/*", schema).withColumnRenamed("text", "code"), "code")
    longest = metrics.longest_within_limit(records.length_filter(first, max_chars=20_000, max_tokens=5_000))
    return readers.read_selected_file(spark, longest, schema)


@query
def read_labelled_csv(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("text").alias("code"), F.col("source").alias("label"), "lang")
    path = writers.write_report_csv(docs, scratch_path(spark, "csv"), "run", "labelled.csv", header=False)
    return readers.read_labelled_csv(spark, path)


@query
def read_pair_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Stored by language, read back for one training split with all its pruning types."""
    pairs = records.make_pairs(document_pairs(spark, sf), "char", keep=["pruning_type"], guid_cols=["doc_id"])
    root = scratch_path(spark, "pairs")
    writers.write_pairs(pairs.withColumns({"lang": F.lit("python"), "partition": F.lit("train")}), root)
    return readers.read_pair_dataset(spark, root, "python", "train", PRUNING_TYPES)


@query
def read_pair_dataset_some(spark: SparkSession, sf: str) -> DataFrame:
    """Of all languages, partitions and pruning types on disk, one language, one partition and two types."""
    pairs = records.make_pairs(document_pairs(spark, sf), "char", keep=["lang", "pruning_type", "doc_id"], guid_cols=["doc_id"])
    part = F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")
    root = scratch_path(spark, "pairs")
    writers.write_pairs(pairs.withColumn("partition", part).drop("doc_id"), root)
    return readers.read_pair_dataset(spark, root, "en", "train", PRUNING_TYPES[:2])


@query
def nested_edit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Nested edits stored as JSON, read, exploded and stored as pairs."""
    edits, pairs = scratch_path(spark, "nested"), scratch_path(spark, "nested-pairs")
    store_nested(nested_edits(spark, sf), edits)
    diff_metric.prepare_nested(spark, edits, pairs)
    return spark.read.parquet(pairs).withColumn("source", F.md5("source"))


@query
def write_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "jsonl")
    writers.write_jsonl(split_documents(spark, sf), root)
    return readers.read_partitioned_jsonl(spark, root, DOCUMENT_HIVE)


@query
def write_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All flavours and languages of a stored set, as sizes per directory."""
    pairs = records.make_pairs(document_pairs(spark, sf), "ast", keep=["lang"], guid_cols=["doc_id"])
    root = scratch_path(spark, "pairs")
    writers.write_pairs(pairs.withColumns({"partition": F.lit("train"), "pruning_type": F.lit("all_point")}), root)
    return spark.read.schema(schemas.PAIR_SET).parquet(root)


@query
def write_pairs_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the directories of a stored set, counted by the write."""
    pairs = records.make_pairs(document_pairs(spark, sf), "ast", keep=["pruning_type"], guid_cols=["doc_id"])
    pairs = pairs.withColumns({"lang": F.lit("python"), "partition": F.lit("train")})
    by = {"lang": ["python"], "partition": ["train"], "pruning_type": PRUNING_TYPES}
    return writers.write_pairs_counted(pairs, scratch_path(spark, "pairs"), by).filter("n_rows > 0")


@query
def write_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    report = dataset_sizes(spark, sf)
    path = writers.write_report_csv(report, scratch_path(spark, "report"), "2024-01-01_00-00-00", "sizes.csv")
    return spark.read.schema(report.schema).option("header", True).csv(path)


# -- projections and scalar functions -------------------------------------------


@query
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("func_name"), F.col("lang").alias("language"), F.col("text").alias("code"),
    )
    return records.project_rename(docs)


@query
def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.strip_comments(F.col("text")).alias("text"))


@query
def strip_comments_code(spark: SparkSession, sf: str) -> DataFrame:
    """Turns wrapped in docstrings, comments and unclosed quotes."""
    code = F.concat(
        F.lit('x = "#'), F.col("role"), F.lit('"\n"""'), F.col("text"), F.lit("\"\"\"\n'''"), F.col("text"), F.lit("''' # "), F.col("text"),
        F.lit('\ny = '), F.col("turn").cast("string"), F.lit('\n"""'), F.col("text"),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", X.strip_comments(code).alias("code"))


@query
def flatten_ws(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.flatten_ws(F.col("text")).alias("text"))


@query
def multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    days = event_days(spark, sf)
    return days.select("user_id", "day", *L.multi_hot(F.col("original_ast_node_types"), EVENT_TYPES))


@query
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    named = long_labels(spark, sf).withColumn("name", L.label_decode(F.col("label")))
    return named.select("doc_id", "node_type", "name", L.label_encode(F.col("name")).alias("label"))


@query
def judge(spark: SparkSession, sf: str) -> DataFrame:
    rows = predicted_documents(spark, sf)
    predicted = X.backticked("quality-inference")
    return rows.select(
        "doc_id", L.judge(predicted, F.col("quality")).alias("judge_text"), L.judge(predicted, F.col("quality"), "int").alias("judge_int")
    )


@query
def make_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return records.make_pairs(document_pairs(spark, sf), "char", keep=["doc_id"])


@query
def make_pairs_ast(spark: SparkSession, sf: str) -> DataFrame:
    return records.make_pairs(document_pairs(spark, sf), "ast", keep=["doc_id"], guid_cols=["source", "doc_id"])


@query
def edit_similarity_label(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("d")
    )
    return lines.select("l_orderkey", L.edit_similarity_label(F.col("n"), F.col("d")).alias("label"))


@query
def pooler_tag(spark: SparkSession, sf: str) -> DataFrame:
    return model_paths(spark, sf).select("doc_id", X.pooler_tag(F.col("path")).alias("tag"))


@query
def pooler_name(spark: SparkSession, sf: str) -> DataFrame:
    return model_paths(spark, sf).select("doc_id", "pooler")


@query
def report_name(spark: SparkSession, sf: str) -> DataFrame:
    paths = model_paths(spark, sf)
    sets = F.array(F.lit("back_seq"), F.concat_ws("_", "lang", "source"))
    run = F.concat(F.lit("run"), F.col("doc_id").cast("string"))
    return paths.select("doc_id", X.report_name(run, sets, F.array("pooler")).alias("name"))


@query
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", X.path_dir(url).alias("dir"), X.path_file(url).alias("file"), X.path_stem(url).alias("stem"), X.model_slug(url).alias("slug")
    )


@query
def pair_key(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("source"))
    right = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("target"))
    return left.join(right, "vec_id").select("vec_id", X.pair_key(F.col("source"), F.col("target")).alias("pair"))


@query
def cluster_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", X.cluster_name(F.col("label") - 1).alias("name"))


@query
def split_by_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("label"))
    return records.split_by_label(rows)


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return models.token_counts(documents(spark, sf)).select("doc_id", "token_count")


@query
def token_truncate(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.truncate_tokens(F.col("text"), 510)
    return documents(spark, sf).select("doc_id", F.size(kept).alias("n_tokens"), F.array_join(kept, " ").alias("tokens"))


@query
def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    counted = models.token_counts(documents(spark, sf))
    return records.length_filter(counted, "text").select("doc_id", "token_count")


@query
def route_edits(spark: SparkSession, sf: str) -> DataFrame:
    routed = records.route_edits(event_days(spark, sf), EVENT_TARGETS, EVENT_STOPS, keep=["user_id", "day"])
    return routed.select("user_id", "day", "original", "text", "delete_target_node", *EVENT_TARGETS, "bucket")


@query
def sym_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = L.sym_diff(F.col("original_ast_node_types"), F.col("edited_ast_node_types"))
    return event_days(spark, sf).select("user_id", "day", F.array_join(F.array_sort(diff), ",").alias("diff"))


# -- joins ----------------------------------------------------------------------


@query
def cosine_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cosine_all_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


@query
def cosine_above_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cosine_all_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding", threshold=0.3)


@query
def cosine_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cosine_all_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding", top_k=5)


@query
def cosine_top_k_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The best partners among those above a cosine."""
    return similarity.cosine_all_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding", threshold=0.4, top_k=3)


@query
def fetch_selected_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf)
    return metrics.fetch_selected_group(rows, longest_within_limit(spark, sf))


@query
def align_columns(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("lang").alias("label"))
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    # Both tables have ids that the other lacks, so the match is asked for without an error.
    both = metrics.align_columns(codes, vecs, strict=False)
    return both.select("id", "code", "label", rounded(F.get("embedding", F.lit(0)).cast("double")).alias("first_value"))


# -- aggregations ---------------------------------------------------------------


@query
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_counts(long_labels(spark, sf))


@query
def dataset_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.dataset_sizes(table(spark, sf, "documents"), ["lang", "source"])


def long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return records.melt_by_type(predicted_documents(spark, sf), LABELS, ["doc_id", "lang"], {"actual": "", "pred": "-inference"})


@query
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_counts(long_predictions(spark, sf), ["lang", "node_type"])


@query
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = metrics.binary_metrics(metrics.confusion_counts(long_predictions(spark, sf)))
    return scored.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "precision", "recall", "f1_score")})


@query
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latest_per_key(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"])


@query
def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a training run built from events: the event id is the step."""
    user, step = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    folder = F.concat(F.lit("output/base_"), F.col("event_type"), F.lit("_statement_"), user)
    path = F.concat(folder, F.lit("/checkpoint-"), step, F.lit("/model.bin"))
    return metrics.latest_checkpoints(table(spark, sf, "events").select(path.alias("path")))


@query
def first_record_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_record_per_group(turns(spark, sf), "file", "turn")


@query
def longest_within_limit(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.longest_within_limit(records.length_filter(first_record_per_file(spark, sf), max_chars=200))


@query
def train_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.train_manifest(table(spark, sf, "documents"), batch=32, epochs=7)


# -- sampling -------------------------------------------------------------------


@query
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(labelled_documents(spark, sf), LABELS, 200, "doc_id")


@query
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_n(table(spark, sf, "documents"), 150, "doc_id").select("doc_id", "lang", "text")


@query
def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return sampling.sample_per_group(docs, "lang", languages(docs), 15, "doc_id").select("doc_id", "lang", "text")


@query
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.seeded_shuffle(table(spark, sf, "documents"), "doc_id", batch=32).select("doc_id", "text", "position", "batch_id")


# -- sets and reshaping ---------------------------------------------------------


@query
def union_sets(spark: SparkSession, sf: str) -> DataFrame:
    return records.union_sets(
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id")),
        table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text"),
    )


@query
def melt_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return long_predictions(spark, sf)


@query
def widen_by_type(spark: SparkSession, sf: str) -> DataFrame:
    scored = long_predictions(spark, sf).select(
        "doc_id", "node_type", F.col("pred").alias("inference"), (F.col("pred") * 0.5).alias("score"),
        L.judge(F.col("pred"), F.col("actual")).alias("judge"),
    )
    return records.widen_by_type(scored, LABELS, ["doc_id"])


@query
def explode_edits(spark: SparkSession, sf: str) -> DataFrame:
    return records.explode_edits(nested_edits(spark, sf)).withColumn("source", F.md5("source"))


@query
def explode_edits_nested(spark: SparkSession, sf: str) -> DataFrame:
    kept = records.explode_edits(nested_edits(spark, sf), nested=True)
    return kept.select(
        "filename", F.size("pairs").cast("bigint").alias("n_pairs"),
        F.array_join(F.transform("pairs", lambda p: F.concat_ws("|", p["guid"], p["target"])), "\n").alias("targets"),
        rounded(F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + p["label"]), 3).alias("label_sum"),
    )


# -- vectors --------------------------------------------------------------------


@query
def pool_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(pooled(spark, sf), "doc", cls="cls", max="max", mean="mean")


@query
def pool_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding read as 8 tokens of 8 features, held in one row."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    rows = table(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in vectors.pool_matrix(tokens).items()])
    return exploded(rows, "vec_id", cls="cls", max="max", mean="mean")


@query
def pool_concat(spark: SparkSession, sf: str) -> DataFrame:
    joined = pooled(spark, sf).select("doc", vectors.pool_concat(["mean", "cls"]).alias("vec"))
    return exploded(joined, "doc", value="vec")


@query
def cosine_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    scored = vectors.cosine_pairwise(left.join(right, "vec_id"), {"mean": ("a", "b")})
    return scored.select("vec_id", rounded(F.col("inspect_mean")).alias("inspect_mean"))


@query
def pca_reduce(spark: SparkSession, sf: str) -> DataFrame:
    coords = vectors.pca_reduce(table(spark, sf, "embeddings"), "embedding", 2)
    return coords.select("vec_id", "label", rounded(F.col("pc0")).alias("pc0"), rounded(F.col("pc1")).alias("pc1"))


@query
def pca_reduce_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The same coordinates by passes with a thin matrix."""
    coords = reduction.pca_reduce_wide(table(spark, sf, "embeddings"), "embedding", 2)
    return coords.select("vec_id", "label", rounded(F.col("pc0")).alias("pc0"), rounded(F.col("pc1")).alias("pc1"))


@query
def density_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.density_cluster(table(spark, sf, "embeddings"), "vec_id", "embedding", CLUSTER_COSINE, CLUSTER_MIN_PTS)


@query
def reachability_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The spanning tree behind hierarchical clusters, as the number of its edges by weight: the same for every such tree."""
    tree = hierarchy.reachability_tree(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return tree.groupBy(rounded(F.col("weight")).alias("weight")).agg(F.count("*").alias("n_edges"))


@query
def hierarchical_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of varying density in the plane of the first two principal components."""
    coords = vectors.pca_reduce(table(spark, sf, "embeddings"), "embedding", 2)
    found = hierarchy.hierarchical_cluster(coords.select("vec_id", F.array("pc0", "pc1").alias("vec")), "vec_id", "vec")
    return found.select("vec_id", "cluster", X.cluster_name(F.col("cluster")).alias("label_type"))


@query
def embedding_table(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.embedding_table(pca_reduce(spark, sf), density_cluster(spark, sf), "vec_id", ["label"])


# -- models ---------------------------------------------------------------------


@query
def batch_embed(spark: SparkSession, sf: str) -> DataFrame:
    embedded = models.batch_embed(documents(spark, sf).select("doc_id", "text"))
    rows = embedded.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.filter("value > 0").select("doc_id", "dim", F.col("value").cast("bigint").alias("n"))


@query
def batch_encode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token matrices of the conversation turns, pooled."""
    chats = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    encoded = models.batch_encode_tokens(chats)
    pooled_rows = encoded.select("id", *[c.alias(n) for n, c in vectors.pool_matrix(F.col("tokens")).items()])
    return exploded(pooled_rows, "id", cls="cls", max="max", mean="mean")


@query
def embed_long(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents through an encoder of 128 tokens whose vectors depend on two neighbours on either side, pooled."""
    encoder = windowed.hashed_context_encoder(4, 2)
    found = windowed.embed_long_pooled(documents(spark, sf).select("doc_id", "text"), "doc_id", "text", encoder, window=128, overlap=8)
    # Texts of one or two tokens have no vector between the ends, and are left out.
    return exploded(found.filter("mean IS NOT NULL"), "doc_id", cls="cls", max="max", mean="mean")


@query
def inference_table(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table behind the subtree report."""
    docs = labelled_documents(spark, sf).withColumn("text", X.strip_comments(F.col("text")))
    rules = {"quality": models.length_rule(500, 200), "toxic": models.length_rule(5000, 900)}
    wide = subtree.inference_table(docs, rules, "doc_id", sample_size=60)
    scored = wide.withColumns({f"{t}-score": rounded(X.backticked(f"{t}-score")) for t in LABELS})
    return scored.select("doc_id", *X.columns([f"{t}-{part}" for t in LABELS for part in ("inference", "score", "judge")]))


@query
def batch_classify(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"quality": models.length_rule(500, 200), "toxic": models.length_rule(5000, 900)}
    scored = models.batch_classify(documents(spark, sf).select("doc_id", "text"), rules)
    return scored.select(
        "doc_id", *[c for t in LABELS for c in (X.backticked(f"{t}-inference"), rounded(X.backticked(f"{t}-score")).alias(f"{t}-score"))]
    )


@query
def train_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    train, valid = disjoint_halves(labelled_documents(spark, sf))
    _, report = models.train_classifiers(train, valid, LABELS, 200, "doc_id")
    return report


@query
def train_by_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Validation metrics of every epoch, both labels trained together."""
    train, valid = disjoint_halves(labelled_documents(spark, sf))
    return training.train_by_epoch(train, valid, LABELS, 200, "doc_id", epochs=3, steps=5).history


# -- the three chains -----------------------------------------------------------


@query
def subtree_report(spark: SparkSession, sf: str) -> DataFrame:
    """Label, sample, classify and score: the subtree-detection chain on the labelled documents."""
    docs = labelled_documents(spark, sf).withColumn("text", X.strip_comments(F.col("text")))
    rules = {"quality": models.length_rule(500, 200), "toxic": models.length_rule(5000, 900)}
    report = subtree.evaluate_sample(docs, rules, "doc_id", sample_size=60)
    return report.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "precision", "recall", "f1_score")})


@query
def trained_report(spark: SparkSession, sf: str) -> DataFrame:
    """Train, store, find the newest checkpoint in the listing, load, classify held-out documents, and score."""
    train, valid = disjoint_halves(labelled_documents(spark, sf))
    root = scratch_path(spark, "models")
    for step, size in ((1, 20), (2, 200)):
        fitted, _ = models.train_classifiers(train, valid, LABELS, size, "doc_id", candidates=(0.1,))
        subtree.store_models({f"{t}_statement": m for t, m in fitted.items()}, root, "run", step)
    held = valid.select("doc_id", "text", *[F.col(t).alias(f"{t}_statement") for t in LABELS])
    report = subtree.report_with_newest(held, root, "doc_id")
    return report.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "precision", "recall", "f1_score")})


@query
def edit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Route edits, classify what is left, and score target and other deletions apart."""
    days = event_days(spark, sf)
    rules = {t: models.length_rule(13 + i, 1) for i, t in enumerate(EVENT_TARGETS)}
    report = subtree.evaluate_edits(days, rules, EVENT_STOPS)
    return report.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "precision", "recall", "f1_score")})


@query
def diff_metric_report(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine of each turn of the longest fitting conversation with its stripped text."""
    rows = turns(spark, sf).select("file", "turn", F.col("code").alias("cleaned_code"), X.strip_comments(F.col("code")).alias("edited_code"))
    encoders = {"cls": models.hashed_token_encoder(32), "mean": models.hashed_token_encoder(64)}
    report = diff_metric.inspect_longest(rows, "turn", encoders, max_chars=200)
    return report.withColumns({f"inspect_{p}": rounded(F.col(f"inspect_{p}")) for p in encoders})


@query
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs sampled per pruning type, shuffled and cut into batches."""
    pairs = records.make_pairs(document_pairs(spark, sf), "char", keep=["doc_id", "pruning_type"], guid_cols=["doc_id"])
    return diff_metric.training_set(pairs, PRUNING_TYPES, per_type=50, id_col="doc_id", batch=2, strict=False).select(
        "doc_id", "pruning_type", "source", "target", "label", "position", "batch_id"
    )


@query
def embedding_report(spark: SparkSession, sf: str) -> DataFrame:
    """Encode, pool, reduce and cluster the benchmark texts."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("code"), F.md5("text").alias("label"))
    report = embedding.analyse(embedding.embed(items, pooling="mean"), "item_id", threshold=0.9, min_pts=2)
    return report.withColumns({c: rounded(F.col(c)) for c in ("pc0", "pc1")})


@query
def embedding_cosines(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine matrix of the pooled benchmark texts."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("code"), F.col("item_id").alias("label"))
    return embedding.cosine_matrix(embedding.embed(items, pooling="max"), "item_id")
