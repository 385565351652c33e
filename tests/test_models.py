import hashlib
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from codepairs.operators import models
from codepairs.plans import diff_metric, embedding, subtree


def embed(text, dim):
    out = np.zeros(dim)
    for t in re.findall(r"\w+|[^\w\s]", text):
        out[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
    return out


def test_batch_embed(spark):
    texts = ["def f(x): return x", "", "ü = 1\n" * 500]
    rows = models.batch_embed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), batch_size=2).collect()
    for r in rows:
        np.testing.assert_array_equal(r.embedding, embed(texts[r.id], 64))


def test_a_model_is_called_once_per_row(spark):
    rows = spark.createDataFrame([(0, "a")], "id int, text string")
    embedded = models.batch_embed(rows).select("id", F.posexplode("embedding").alias("dim", "value")).filter("value > 0")
    assert embedded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    classified = models.batch_classify(rows, {t: models.length_rule(1, 1) for t in "abc"})
    assert classified._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_plugged_tokenizer(spark):
    import pandas as pd

    def words(s: pd.Series) -> pd.Series:
        return s.str.split().str.len().astype("int32")

    rows = spark.createDataFrame([("a b+c",)], "text string")
    assert models.token_counts(rows, tokenizer=words).first().token_count == 2
    assert models.token_counts(rows).first().token_count == 4


def test_batch_classify(spark):
    rows = spark.createDataFrame([(0, "x" * 10), (1, "x" * 30)], "id int, text string")
    got = models.batch_classify(rows, {"a": models.length_rule(20, 5), "b-c": models.length_rule(5, 1)}).orderBy("id").collect()
    assert [(r["a-inference"], r["b-c-inference"]) for r in got] == [(0, 1), (1, 1)]
    assert got[0]["a-score"] == pytest.approx(1 / (1 + np.exp(-2)))
    assert set(got[0].asDict()) == {"id", "text", "a-inference", "a-score", "b-c-inference", "b-c-score"}


def test_train_classifiers(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, ("if x: pass" if i % 2 else "while y: go") + f" v{i}", i % 2, int(i % 5 == 0)) for i in range(120)],
        "id int, text string, if_statement int, noise int",
    )
    trained, report = models.train_classifiers(rows, rows, ["if_statement", "noise"], 60, "id", save_root=str(tmp_path))
    scores = {r.node_type: r for r in report.collect()}
    assert scores["if_statement"].accuracy == 1.0
    assert set(trained) == {"if_statement", "noise"}
    loaded = {"if_statement": PipelineModel.load(str(tmp_path / "if_statement"))}
    scored = models.classify_with(loaded, rows)
    assert scored.filter(F.col("`if_statement-inference`") != F.col("if_statement")).isEmpty()
    assert scored.agg(F.min("`if_statement-score`")).first()[0] > 0.5
    judged = subtree.with_judgements(scored, ["if_statement"], "text")
    assert judged.select("`if_statement-judge`").distinct().first()[0] == "CORRECT"


def test_train_classifiers_in_a_session_that_has_observed(spark):
    spark.range(3).observe(Observation(), F.count("*").alias("n")).collect()
    rows = spark.createDataFrame([(i, "if x" if i % 2 else "while y", i % 2) for i in range(40)], "id int, text string, if_statement int")
    trained, report = models.train_classifiers(rows, rows, ["if_statement"], 20, "id")
    assert report.first().accuracy == 1.0
    scored = models.classify_with(trained, rows)
    assert scored.filter(F.col("`if_statement-inference`") != F.col("if_statement")).isEmpty()


def test_evaluate_edits(spark):
    schema = "original_code string, edited_code string, delete_target_node string, original_ast_node_types array<string>, edited_ast_node_types array<string>"
    rows = spark.createDataFrame([("o", "x" * 9, "if_statement", ["if_statement"], []), ("o", "x", "call", ["call", "if_statement"], ["if_statement"])], schema)
    got = {(r.bucket, r.node_type): r for r in subtree.evaluate_edits(rows, {"if_statement": models.length_rule(5, 1)}).collect()}
    assert got["target", "if_statement"].false_positive == 1
    assert got["others", "if_statement"].false_negative == 1


def test_inspect_longest(spark):
    rows = spark.createDataFrame(
        [("a", 0, "x y\n z", "x y"), ("a", 1, "x y\n z", "q"), ("b", 0, "x", "x"), ("c", 0, "x " * 500, "x")],
        "file string, line int, cleaned_code string, edited_code string",
    )
    got = diff_metric.inspect_longest(rows, "line", {"cls": models.hashed_token_encoder(32)}).orderBy("line").collect()
    assert [r.file for r in got] == ["a", "a"]
    a, b = embed("x y z", 32), embed("x y", 32)
    assert got[0].inspect_cls == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert got[0].flattened_code == "x y z"


def test_inspection_takes_one_python_worker_a_task(spark):
    rows = spark.createDataFrame([("a", 0, "x y", "x")], "file string, line int, cleaned_code string, edited_code string")
    encoders = {"cls": models.hashed_token_encoder(32), "mean": models.hashed_token_encoder(64)}
    plan = diff_metric.inspect_longest(rows, "line", encoders)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_training_set(spark):
    pairs = spark.range(200).select("id", F.when(F.col("id") < 150, "back_seq").otherwise("all_point").alias("pruning_type"))
    got = diff_metric.training_set(pairs, ["back_seq", "all_point"], 30, "id", batch=8).collect()
    assert sorted(r.position for r in got) == list(range(60))
    assert sum(r.pruning_type == "back_seq" for r in got) == 30
    assert max(r.batch_id for r in got) == 59 // 8


def test_analyse(spark):
    rows = spark.createDataFrame(
        [(i, code, f"l{i}") for i, code in enumerate(["if a: b", "if a: b", "if a: c", "while x", "while x", "z"])], "id int, code string, label string"
    )
    embedded = embedding.embed(rows, pooling="mean")
    got = {r.id: r for r in embedding.analyse(embedded, "id", threshold=0.999, min_pts=2).collect()}
    assert got[0].label_type == got[1].label_type == "cluster-0"
    assert got[3].label_type == got[4].label_type == "cluster-1"
    assert got[5].label_type == "noise"
    assert {"pc0", "pc1", "code", "label"} <= set(got[0].asDict())
    matrix = embedding.cosine_matrix(embedded, "id").collect()
    assert len(matrix) == 36
    assert {r.cosSim for r in matrix if r.source == r.target} == {1.0}


def test_batch_encode_tokens(spark):
    texts = ["a b", "", "x" * 10, *[f"t{i} = {i}" for i in range(200)]]
    rows = models.batch_encode_tokens(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), batch_size=7).collect()
    assert [r.text for r in rows] == texts
    for r in rows:
        tokens = ["<s>", *re.findall(r"\w+|[^\w\s]", r.text), "</s>"]
        want = [[(b - 127.5) / 127.5 for b in hashlib.md5(t.encode()).digest()[:8]] for t in tokens]
        np.testing.assert_allclose(r.tokens, want, rtol=1e-6)


def test_reports_are_written(spark, tmp_path):
    schema = "original_code string, edited_code string, delete_target_node string, original_ast_node_types array<string>, edited_ast_node_types array<string>"
    rows = spark.createDataFrame([("o", "x" * 9, "if_statement", ["if_statement"], []), ("o", "x", "call", ["call"], [])], schema)
    wide = subtree.edit_table(rows, {"if_statement": models.length_rule(5, 1)})
    inference, evaluate = subtree.write_reports(wide, ["if_statement"], str(tmp_path), "run", ["bucket"])
    back = spark.read.option("header", True).csv(inference)
    assert {(r.bucket, r["if_statement-judge"]) for r in back.collect()} == {("target", "0"), ("others", "1")}
    assert spark.read.option("header", True).csv(evaluate).count() == 2
    path = diff_metric.write_inspection(rows.select("original_code"), str(tmp_path), "run", ["all_point"], ["cls", "max"])
    assert path.endswith("run/run_all-point_cls-max.csv") and spark.read.option("header", True).csv(path).count() == 2
