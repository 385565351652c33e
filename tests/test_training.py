"""Training by epochs against plain numpy on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codepairs.operators.metrics import latest_checkpoints
from codepairs.operators.sampling import balanced_sample
from codepairs.operators.training import classify_trained, stored_classifiers, token_buckets, train_by_epoch
from codepairs.sources.readers import list_paths

FEATURES = 64


@pytest.fixture(scope="module")
def corpus(spark):
    """Two flags that words decide, one that nothing decides."""
    rows = []
    rng = np.random.default_rng(2)
    for i in range(240):
        words = [f"w{rng.integers(30)}" for _ in range(12)]
        a, b = int(rng.random() < 0.5), int(rng.random() < 0.3)
        words += ["if ( x )"] * (2 * a) + ["while"] * (3 * b)
        rows.append((i, " ".join(words) if i % 40 else None, a, b, int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "id long, text string, a int, b int, c int").fillna({"text": ""}).persist()
    return df.filter("id % 4 > 0"), df.filter("id % 4 = 0")


def plain(rows, penalty, steps):
    """The same steps over a dense matrix."""
    x = np.zeros((len(rows), FEATURES + 1))
    for i, r in enumerate(rows):
        np.add.at(x[i], r["buckets"], 1.0)
    x = np.log1p(x)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    x[:, FEATURES] = 1.0
    y = np.array([r["label"] for r in rows])
    l2 = np.append(np.full(FEATURES, penalty), 0.0)
    here = ahead = np.zeros(FEATURES + 1)
    pace, rate = 1.0, 1 / (0.5 + 1e-2)
    for _ in range(steps):
        slope = x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(y) + l2 * ahead
        moved = ahead - rate * slope
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, here, pace = moved + (pace - 1) / after * (moved - here), moved, after
    return here


def test_equals_separate_fits(spark, corpus, tmp_path):
    train, valid = corpus
    both = train_by_epoch(train, valid, ["a", "b", "c"], 100, "id", features=FEATURES, candidates=(1e-2, 1e-3), epochs=2, steps=4, save_root=str(tmp_path))
    sample = balanced_sample(train, ["a", "b", "c"], 100, "id", "text", 42)
    stored = {(r.node_type, r.epoch, r.reg_param): r for n in (1, 2) for r in spark.read.parquet(f"{tmp_path}/checkpoint-{n}").collect()}
    assert len(stored) == 12
    for t in "abc":
        rows = sample.filter(F.col("node_type") == t).select("label", token_buckets(F.col("sentence"), FEATURES).alias("buckets")).collect()
        for epoch, penalty in ((1, 1e-2), (2, 1e-2), (2, 1e-3)):
            want = plain(rows, penalty, 4 * epoch)
            got = stored[t, epoch, penalty]
            assert np.allclose([*got.weights, got.bias], want, atol=1e-9)
    # Verdicts of one type alone are those of all together.
    alone = train_by_epoch(train, valid, ["b"], 100, "id", features=FEATURES, candidates=(1e-2, 1e-3), epochs=2, steps=4)
    for models in (both.models, stored_classifiers(spark, str(tmp_path))):
        x = classify_trained({"b": models["b"]}, valid).select("id", "`b-inference`")
        y = classify_trained(alone.models, valid).select("id", "`b-inference`")
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    best = both.history.filter("node_type = 'b'").agg(F.max("accuracy")).first()[0]
    assert best > 0.9
    newest = latest_checkpoints(list_paths(spark, str(tmp_path)).withColumn("path", F.concat(F.lit("/if_statement"), "path"))).first()
    assert newest.step == 2


def test_jobs_do_not_grow_with_types(spark, corpus):
    train, valid = corpus
    wide = train.select("*", *[F.col("a").alias(f"a{i}") for i in range(6)])
    held = valid.select("*", *[F.col("a").alias(f"a{i}") for i in range(6)])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n, types in enumerate((["a"], ["a", "b", *[f"a{i}" for i in range(6)]])):
        spark.sparkContext.setJobGroup(f"train-{n}", "")
        train_by_epoch(wide, held, types, 60, "id", features=16, candidates=(1e-3,), epochs=2, steps=2)
        jobs.append(len(tracker.getJobIdsForGroup(f"train-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 2


def test_types_without_both_classes(spark, corpus):
    train, valid = corpus
    none = train.withColumn("d", F.lit(1))
    got = train_by_epoch(none, valid.withColumn("d", F.lit(0)), ["d"], 50, "id", features=16)
    assert got.models == {} and got.history.collect() == []
    assert classify_trained({}, valid).columns == valid.columns


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x y")], "id long, text string")
    got = classify_trained({"t": (0.5, [1.0, -1.0])}, df).orderBy("id").collect()
    assert [r["t-inference"] for r in got][:2] == [1, 1] and abs(got[0]["t-score"] - 1 / (1 + np.exp(-0.5))) < 1e-12
