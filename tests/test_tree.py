"""The tree data source: pushed filters, one-job writes, commits and aborts."""

import gzip
import json
import os
import tracemalloc
import uuid

import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs import catalog
from codepairs.sources import readers, schemas, tree
from codepairs.sources.ranges import CHUNK_BYTES
from codepairs.sources.tree import TreeReader, TreeWriter, Written, from_name, read_jsonl_tree, to_name, tree_sizes, write_jsonl_files

ITEM = schemas.fields(id=T.LongType(), text=T.StringType())
NAMES = ["python", "go lang", None, "", "a/b", "%41", "_x", ".y", "ü"]


def table(spark, n=90):
    names = F.array(*[F.lit(x) for x in NAMES])
    part = F.when(F.col("id") % 2 == 0, "train").otherwise("test")
    text = F.concat(F.lit("é\n"), F.col("id").cast("string"))
    return spark.range(n).select("id", F.when(F.col("id") % 4 > 0, text).alias("text"), names[(F.col("id") % len(NAMES)).cast("int")].alias("lang"), part.alias("partition"))


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith(".") and not f.endswith(".crc"))


@pytest.mark.parametrize("name", NAMES)
def test_names(name):
    made = to_name(name)
    assert from_name(made) == name and made and "/" not in made and (name is None or made[0] not in "._")


def test_round_trip_and_sizes(spark, tmp_path):
    root = str(tmp_path / "t")
    df = table(spark)
    write_jsonl_files(df, root)
    back = read_jsonl_tree(spark, root, ITEM, split_bytes=50)
    assert sorted(map(tuple, back.select(df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sizes = {(r.lang, r.partition): r.rows for r in tree_sizes(spark, root).collect()}
    assert sizes == {(r.lang, r.partition): r["count"] for r in df.groupBy("lang", "partition").count().collect()}
    with pytest.raises(FileExistsError):
        write_jsonl_files(df, root)
    write_jsonl_files(df.filter("id < 10"), root, mode="append")
    assert read_jsonl_tree(spark, root, ITEM).count() == 100
    write_jsonl_files(df.filter("lang = 'python'"), root, mode="overwrite")
    assert read_jsonl_tree(spark, root, ITEM).count() == 10
    assert all(f.startswith(("python/", "_manifest")) for f in files(root))


def test_leaf_layout_is_read_by_the_plain_reader(spark, tmp_path):
    root = str(tmp_path / "t")
    df = table(spark).filter("lang = 'python'")
    write_jsonl_files(df, root, by=("lang", "partition"), leaf="programs")
    got = readers.read_jsonl_dir(spark, root, "python", "train", ITEM, strict=False)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.filter("partition = 'train'").collect())
    assert any(f.startswith("python/train/programs.jsonl/part-") for f in files(root))


@pytest.mark.parametrize(
    "condition",
    ["lang = 'en'", "lang IN ('en', 'x') AND partition = 'train'", "lang LIKE 'e%'", "lang <> 'de' AND lang IS NOT NULL", "partition = 'train' AND id > 3 AND lang <=> 'en'", "NOT lang IN ('de') AND text IS NOT NULL"],
)
def test_filters_open_their_files_only(spark, tmp_path, condition):
    """Other languages' files say that they are compressed and are not, which fails when they are read."""
    for lang in ("en", "de"):
        for part in ("train", "test"):
            path = tmp_path / lang / (f"{part}.v1.jsonl" if lang == "en" else f"{part}.jsonl.gz")
            path.parent.mkdir(exist_ok=True)
            if lang == "en":
                path.write_text("".join(json.dumps({"id": i, "text": "t"}) + "\n" for i in range(9)))
            else:
                path.write_text("not compressed")
    rows = read_jsonl_tree(spark, str(tmp_path), ITEM)
    with pytest.raises((PySparkException, Py4JJavaError)):
        rows.collect()
    got = rows.filter(condition)
    assert {(r.lang, r.text) for r in got.collect()} == {("en", "t")}
    assert got.count() == {"lang IN ('en', 'x') AND partition = 'train'": 9, "partition = 'train' AND id > 3 AND lang <=> 'en'": 5}.get(condition, 18)


def test_unmatched_directories_are_not_listed(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    for lang in ("en", "de", "fr"):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "train.jsonl").write_text("{}\n")
    reader = TreeReader(str(tmp_path), ["lang", "partition"], 1000)
    kept = list(reader.pushFilters([EqualTo(("lang",), "en"), GreaterThan(("line",), "x"), EqualTo(("line",), "y")]))
    assert len(kept) == 2 and len(reader.filters) == 1
    (tmp_path / "de").chmod(0)
    import codepairs.sources.tree as tree

    seen = []
    plain = tree.fs.FileSelector
    monkeypatch.setattr(tree.fs, "FileSelector", lambda path, *a, **k: (seen.append(os.path.basename(path)), plain(path, *a, **k))[1])
    assert [p.values for b in reader.partitions() for p in b.pieces] == [("en", "train")]
    assert seen == [tmp_path.name, "en"]
    (tmp_path / "de").chmod(0o755)


def test_null_names_in_the_plain_readers(spark, tmp_path):
    df = table(spark).filter("lang is null or lang = 'python'")
    write_jsonl_files(df, str(tmp_path / "t"))
    got = readers.read_jsonl_partitions(spark, str(tmp_path / "t"), ITEM, strict=False)
    assert {(r.lang, r.partition): r["count"] for r in got.groupBy("lang", "partition").count().collect()} == {
        (r.lang, r.partition): r["count"] for r in df.groupBy("lang", "partition").count().collect()
    }


def test_splits_and_bunches(spark, tmp_path):
    write = tmp_path / "en"
    write.mkdir()
    (write / "big.jsonl").write_text("".join(json.dumps({"id": i, "text": "x" * (i % 50)}) + "\n" for i in range(500)))
    for i in range(20):
        (write / f"small{i}.jsonl").write_text(json.dumps({"id": 1000 + i, "text": None}) + "\r\n\n")
    for split in (64, 1000, 1 << 20):
        rows = read_jsonl_tree(spark, str(tmp_path), ITEM, split_bytes=split)
        assert sorted(r.id for r in rows.collect()) == [*range(500), *range(1000, 1020)]
    assert len(TreeReader(str(tmp_path), ["lang", "partition"], 1 << 20).partitions()) == 1
    assert len(TreeReader(str(tmp_path), ["lang", "partition"], 1000).partitions()) > 15


def test_a_failed_task_leaves_no_extra_rows(spark, tmp_path):
    """An attempt that died, as one is repeated: its part is there, and no message tells of it."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["train", "train"]), pa.array(['{"id": 1}', '{"id": 2}'])], names=["lang", "partition", "line"])
    writer = TreeWriter(str(tmp_path), ["lang", "partition"], None, False)

    def dies():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert len(files(tmp_path)) == 2
    told = writer.write(iter([batch]))
    assert isinstance(told, Written) and len(files(tmp_path)) == 4
    writer.commit([told, None])
    assert len(files(tmp_path)) == 3  # two parts and the manifest
    assert sorted(r.id for r in read_jsonl_tree(spark, str(tmp_path), ITEM).collect()) == [1, 2]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    df = table(spark).repartition(4)
    bad = df.withColumn("text", F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises((PySparkException, Py4JJavaError)):
        write_jsonl_files(bad, str(tmp_path / "t"))
    assert files(tmp_path) == []


def test_write_is_one_job_whatever_the_directories(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n, langs in enumerate((2, 30)):
        df = spark.range(300).select("id", (F.col("id") % langs).cast("string").alias("lang"), F.lit("train").alias("partition"))
        spark.sparkContext.setJobGroup(f"write-{n}", "")
        write_jsonl_files(df, str(tmp_path / f"t{n}"))
        jobs.append(len(tracker.getJobIdsForGroup(f"write-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 2


def test_bad_lines(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "train.jsonl").write_text('{"id": 1}\n{broken\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_jsonl_tree(spark, str(tmp_path), ITEM).collect()
    loose = read_jsonl_tree(spark, str(tmp_path), ITEM, strict=False).collect()
    assert sorted((r.id or 0, r._corrupt_record) for r in loose) == [(0, "{broken"), (1, None)]


def test_empty(spark, tmp_path):
    write_jsonl_files(table(spark).filter("id < 0"), str(tmp_path / "t"))
    assert read_jsonl_tree(spark, str(tmp_path / "t"), ITEM).collect() == []


def test_large_batches_are_written_in_chunks(tmp_path):
    """Ten thousand long lines arrive at once; they are not all copied at once."""
    lines = [f"{i}-" + "x" * 20_000 for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"] * 1000), pa.array(lines)], names=["lang", "line"])
    writer = TreeWriter(str(tmp_path), ["lang"], None, False)
    tracemalloc.start()
    written = writer.write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(f["rows"] for f in written.files) == 3000 and len(written.files) == 3
    writer.commit([written])
    found = [line for f in tmp_path.glob("**/*.json") if f.name[0] != "_" for line in f.read_text().splitlines()]
    assert sorted(found) == sorted(lines)
    assert peak < 3 * CHUNK_BYTES + 10_000_000


def test_gzipped_parts(spark, tmp_path, monkeypatch):
    """Compressed parts are the same rows to either reader, are told by their lines, and end where one task has enough to read."""
    rows = [(i, f"é {i} " * 40, "en" if i % 3 else None, f"p{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "a long, t string, lang string, partition string")
    schema = "a long, t string"
    for name, gzipped in (("plain", False), ("packed", True)):
        write_jsonl_files(df, str(tmp_path / name), gzipped=gzipped)
    plain, packed = (sorted(p for p in (tmp_path / n).rglob("part-*") if p.is_file()) for n in ("plain", "packed"))
    assert all(p.name.endswith(".json") for p in plain) and all(p.name.endswith(".json.gz") for p in packed)
    assert 3 * sum(p.stat().st_size for p in packed) < sum(p.stat().st_size for p in plain)
    sizes = [sorted(map(tuple, tree_sizes(spark, str(tmp_path / n)).collect()), key=str) for n in ("plain", "packed")]
    assert sizes[0] == sizes[1]
    kind = T._parse_datatype_string(schema)
    for split_bytes in (100, 1 << 20):
        found = read_jsonl_tree(spark, str(tmp_path / "packed"), kind, split_bytes=split_bytes).select("a", "t", "lang", "partition")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    found = readers.read_jsonl_partitions(spark, str(tmp_path / "packed"), kind).select("a", "t", "lang", "partition")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)

    monkeypatch.setattr(tree, "SPLIT_BYTES", 1000)
    writer = tree.TreeWriter(str(tmp_path / "cut"), ["k"], None, False, True)
    lines = [f"{i:0100}" for i in range(95)]
    monkeypatch.setattr(tree, "CHUNK_BYTES", 300)
    told = writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["x"] * 95), pa.array(lines)], names=["k", "line"])]))
    writer.commit([told])
    parts = sorted((tmp_path / "cut").rglob("part-*"))
    texts = [gzip.open(p, "rt").read().splitlines() for p in parts]
    assert len(parts) > 5 and max(map(len, texts)) <= 14 and sorted(sum(texts, [])) == lines


def test_pair_trees_are_stored_compressed(spark, tmp_path, monkeypatch):
    """Both hold a text twice; 1 GB of documents took 3.4 GB."""
    folder = tmp_path / "t"
    docs = [(i, f"x = {i} # note\n" * 50, "en", f"s{i % 9}", 0) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / "scratch" / name / uuid.uuid4().hex))
    for name in ("read_pair_tree", "read_pair_tree_filtered"):
        rows = catalog.QUERIES[name](spark, str(folder)).collect()
        assert all(r.cleaned_code.startswith("x = ") and r.edited_code for r in rows) and len(rows) > 50
    parts = [p for p in (tmp_path / "scratch").rglob("part-*") if p.is_file()]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
