import csv
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.operators.metrics import latest_checkpoints
from codepairs.plans import diff_metric, subtree
from codepairs.sources import readers, schemas, writers

ELEMENT = {"repo": "r", "path": "p", "func_name": "f", "language": "python", "code": "x = 1 # é", "subtree_elements_unique": ["if_statement"]}


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n")


def test_jsonl_partitions(spark, tmp_path):
    put(tmp_path / "python" / "train.jsonl", ELEMENT, {**ELEMENT, "repo": "s"})
    put(tmp_path / "python" / "test.v1.jsonl", ELEMENT)
    put(tmp_path / "go lang" / "train.jsonl", ELEMENT)
    put(tmp_path / "python" / "deep" / "train.jsonl", ELEMENT)
    put(tmp_path / "python" / "train.json", ELEMENT)
    rows = readers.read_jsonl_partitions(spark, str(tmp_path), schemas.SUBTREE_ELEMENT)
    got = sorted((r.lang, r.partition, r.repo) for r in rows.collect())
    assert got == [("go lang", "train", "r"), ("python", "test", "r"), ("python", "train", "r"), ("python", "train", "s")]
    some = readers.read_jsonl_partitions(spark, str(tmp_path), schemas.SUBTREE_ELEMENT, ["python"], ["test", "valid"])
    assert [(r.lang, r.partition) for r in some.collect()] == [("python", "test")]


def test_pair_tree_and_dir_and_file(spark, tmp_path):
    pair = {"cleaned_code": "a\n b", "edited_code": "a", "cos_sim_diff_char": 0.5}
    for lang, part, kind, name in (("python", "train", "back_seq", "p1"), ("python", "train", "back_seq", "p2"), ("python", "test", "all_point", "p1")):
        put(tmp_path / lang / part / kind / f"{name}.jsonl", pair, pair)
    rows = readers.read_pair_tree(spark, str(tmp_path), schemas.CHAR_PAIR)
    sizes = {tuple(r)[:4]: r["count"] for r in rows.groupBy("lang", "partition", "pruning_type", "file").count().collect()}
    assert sizes == {
        ("python", "train", "back_seq", "p1.jsonl"): 2,
        ("python", "train", "back_seq", "p2.jsonl"): 2,
        ("python", "test", "all_point", "p1.jsonl"): 2,
    }
    assert readers.read_pair_tree(spark, str(tmp_path), schemas.CHAR_PAIR, pruning_types=["all_point"]).count() == 2
    assert readers.read_jsonl_dir(spark, str(tmp_path / "python"), "train", "back_seq", schemas.CHAR_PAIR).count() == 4
    assert readers.read_jsonl_file(spark, str(tmp_path / "python"), "train/back_seq", "p1", schemas.CHAR_PAIR).count() == 2
    diff_metric.prepare(spark, str(tmp_path), str(tmp_path / "out"))
    stored = readers.read_pair_dataset(spark, str(tmp_path / "out"), "python", "train", ["back_seq", "all_point"])
    assert {(r.guid, r.source, r.target, r.label, r.pruning_type) for r in stored.collect()} == {("index", "a b", "a", 0.5, "back_seq")}
    assert stored.count() == 4


def test_bad_lines(spark, tmp_path):
    put(tmp_path / "python" / "train.jsonl", ELEMENT, "{broken", {k: v for k, v in ELEMENT.items() if k != "code"})
    strict = readers.read_jsonl_partitions(spark, str(tmp_path), schemas.SUBTREE_ELEMENT)
    with pytest.raises((PySparkException, Py4JJavaError), match="[Mm]alformed"):
        strict.collect()
    loose = readers.read_jsonl_partitions(spark, str(tmp_path), schemas.SUBTREE_ELEMENT, strict=False)
    good, quarantine = schemas.split_incomplete(loose, schemas.SUBTREE_ELEMENT.names)
    assert (good.count(), quarantine.count()) == (1, 2)
    assert "{broken" in [r._corrupt_record for r in quarantine.collect()]


def test_missing_field_is_an_error_only_when_used(spark, tmp_path):
    put(tmp_path / "python" / "train.jsonl", {k: v for k, v in ELEMENT.items() if k != "code"})
    rows = readers.read_jsonl_partitions(spark, str(tmp_path), schemas.SUBTREE_ELEMENT)
    assert rows.select("repo").first().repo == "r"
    with pytest.raises(PySparkException, match="missing field: code"):
        rows.select("code").collect()


def test_nested_json(spark, tmp_path):
    doc = {"filename": "f", "original_code": "a\nb", "num_of_nodes": 10, "edited_code": [{"code": "y", "count": 1}], "more": 1}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "filename": "g", "edited_code": []}))
    (tmp_path / "c.jsonl").write_text("{}")
    rows = readers.read_nested_json(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.original_code, r.num_of_nodes, [tuple(e) for e in r.edited_code]) for r in rows] == [
        ("f", "a\nb", 10, [("y", 1)]),
        ("g", "a\nb", 10, []),
    ]


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_labelled_csv(spark, tmp_path, terminator, quoting):
    rows = [['say "hi"\n  x, y', "one"], ["b", "two", "extra", "more"], ["", "empty"], ["c", ""]]
    path = tmp_path / "in.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, quoting=quoting, lineterminator=terminator).writerows(rows)
    got = sorted(tuple(r) for r in readers.read_labelled_csv(spark, str(path)).collect())
    assert got == sorted((r[0], r[1]) for r in rows)
    with path.open("a", newline="") as f:
        csv.writer(f, quoting=quoting, lineterminator=terminator).writerow(["alone"])
    with pytest.raises(PySparkException, match="row without a label"):
        readers.read_labelled_csv(spark, str(path)).collect()
    assert readers.read_labelled_csv(spark, str(path), strict=False).filter("label IS NULL").count() == 1


def test_first_record_per_file(spark, tmp_path):
    line = lambda c: {"cleaned_code": c, "edited_code": "e"}
    put(tmp_path / "a.jsonl", line("first"), *[line(f"later {i}") for i in range(200)])
    put(tmp_path / "b.jsonl", "{broken", line("second"))
    put(tmp_path / "c.jsonl", "", line("second"))
    put(tmp_path / "d e.jsonl", line("only"))
    (tmp_path / "empty.jsonl").write_text("")
    for size in (1 << 16, 5):
        rows = readers.first_record_per_file(spark, f"{tmp_path}/*.jsonl", schemas.fields(cleaned_code=T.StringType()), size).collect()
        assert sorted((r.file.rsplit("/", 1)[-1], r.cleaned_code) for r in rows) == [("a.jsonl", "first"), ("d e.jsonl", "only")]


def test_first_lines_of_large_files_read_little(spark, tmp_path, monkeypatch):
    """Files of 100 MB, most of it holes; bytes read are bounded by the first lines."""
    for i, text in enumerate(("{\"n\": 1}", "{\"n\": 2}\r", "{" + " " * 200_000 + "\"n\": 3}", "no json")):
        with (tmp_path / f"f{i}.jsonl").open("wb") as file:
            file.write(text.encode() + b"\n{\"n\": 9}\n")
            file.truncate(100 << 20)
    read = []
    plain = readers.chunks
    monkeypatch.setattr(readers, "chunks", lambda *a: (read.append(len(d)) or d for d in plain(*a)))
    lines = [readers.first_line(str(tmp_path / f"f{i}.jsonl")) for i in range(4)]
    assert [len(x) for x in lines] == [8, 8, 200_008, 7] and sum(read) <= 200_008 + 4 * readers.FIRST_BYTES
    monkeypatch.undo()
    got = readers.first_record_per_file(spark, str(tmp_path), schemas.fields(n=T.LongType()))
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]


def test_selected_file_alone_is_read(spark, tmp_path):
    schema = schemas.fields(code=T.StringType())
    for name, n in (("a[1].jsonl", 2), ("b.jsonl", 3), ("c{x}.jsonl", 4)):
        put(tmp_path / name, *[{"code": f"{name} {i}"} for i in range(n)])
    files = readers.first_record_per_file(spark, str(tmp_path), schema)
    for name, n in (("a[1].jsonl", 2), ("c{x}.jsonl", 4)):
        got = readers.read_selected_file(spark, files.filter(F.col("file").endswith(name)), schema)
        assert len(got.inputFiles()) == 1 and sorted(r.code for r in got.collect()) == [f"{name} {i}" for i in range(n)]
    assert readers.read_selected_file(spark, files.filter("code = 'none'"), schema).collect() == []


def test_sizes_are_counted_by_the_write(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("python").alias("lang"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), (F.col("id") % 4).cast("string"))).alias("kind"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    source = rows.mapInArrow(counted, rows.schema)
    by = {"lang": ["python", "go"], "kind": ["t1", "t2", "t3", None]}
    sizes = writers.write_pairs_counted(source, str(tmp_path / "p"), by).collect()
    assert {(r.lang, r.kind): r.n_rows for r in sizes} == {(x, k): 25 if x == "python" else 0 for x in ("python", "go") for k in by["kind"]}
    assert reads.value == 100  # one scan
    with pytest.raises((PySparkException, Py4JJavaError), match="not named"):
        writers.write_pairs_counted(rows, str(tmp_path / "q"), by | {"kind": ["t1"]})
    assert not (tmp_path / "q" / "_SUCCESS").exists()


def test_writers_partition_and_keep_text(spark, tmp_path):
    rows = spark.createDataFrame([("é", None, "python", "train"), ("x", 1, "go", "test")], "text string, n int, lang string, partition string")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    files = list((tmp_path / "j" / "lang=python" / "partition=train").glob("*.json"))
    assert files and files[0].read_text() == '{"text":"é","n":null}\n'
    back = readers.read_partitioned_jsonl(spark, str(tmp_path / "j"), rows.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    plan = back.filter("lang = 'go'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_tree_writer_is_read_back(spark, tmp_path):
    rows = spark.range(30).select("id", F.when(F.col("id") < 20, "python").otherwise("go").alias("lang"), F.lit("train").alias("partition"))
    writers.write_jsonl_tree(rows, str(tmp_path / "t"), {"lang": ["python", "go"], "partition": ["train"]})
    back = readers.read_jsonl_partitions(spark, str(tmp_path / "t"), schemas.fields(id=T.LongType()))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_report_csv(spark, tmp_path):
    rows = spark.createDataFrame([(' a "q"\nb ', 0.5)], "text string, score double")
    path = writers.write_report_csv(rows.coalesce(1), str(tmp_path), "run-1", "report.csv")
    assert path == f"{tmp_path}/run-1/report.csv"
    text = "".join(p.read_text() for p in sorted((tmp_path / "run-1" / "report.csv").glob("*.csv")))
    assert list(csv.reader(text.splitlines(keepends=True))) == [["text", "score"], [' a "q"\nb ', "0.5"]]


def test_listing(spark, tmp_path):
    for n in (9, 10):
        put(tmp_path / "base_if_statement_x" / f"checkpoint-{n}" / "model.bin", "x")
    best = latest_checkpoints(readers.list_paths(spark, str(tmp_path))).first()
    assert best.step == 10 and best.checkpoint.endswith("base_if_statement_x/checkpoint-10")


def test_prepare_labels_a_corpus(spark, tmp_path):
    put(tmp_path / "in" / "python" / "train.jsonl", ELEMENT, {**ELEMENT, "subtree_elements_unique": []})
    subtree.prepare(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["if_statement", "else_clause"])
    schema = T.StructType([*schemas.labelled_text(["if_statement", "else_clause"]).fields, T.StructField("partition", T.StringType())])
    rows = readers.read_partitioned_jsonl(spark, str(tmp_path / "out"), schema).collect()
    assert sorted((r.lang, r.partition, r.text, r.if_statement, r.else_clause) for r in rows) == [
        ("python", "train", "x = 1 ", 0, 0),
        ("python", "train", "x = 1 ", 1, 0),
    ]


def test_pairs_of_a_program_hold_it_once_on_disk(spark, tmp_path):
    rng = random.Random(2)
    programs = ["".join(rng.choices("abcdefghijklmnop", k=200_000)) for _ in range(8)]
    items = [{"filename": f"f{i}", "original_code": p, "num_of_nodes": 10, "edited_code": [{"code": f"{i}-{j}", "count": j} for j in range(10)]} for i, p in enumerate(programs)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "all.json").write_text(json.dumps(items))
    diff_metric.prepare_nested(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    pairs = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.num, r.source, r.target) for r in pairs.collect()) == sorted((j, p, f"{i}-{j}") for i, p in enumerate(programs) for j in range(10))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * sum(map(len, programs))
