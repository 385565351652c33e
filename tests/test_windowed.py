"""Windows of long texts against the whole text encoded at once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codepairs.operators.vectors import pool_vectors
from codepairs.operators.windowed import embed_long, embed_long_pooled, hashed_context_encoder, text_tokens, token_windows

SCHEMA = "id long, text string, pos string, vec string, window string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


TEXTS = ["", None, "one", "a b, c.", " ".join(f"w{i % 17}" for i in range(200)), "é 中 " * 33, " ".join(f"t{i}" for i in range(41))]


@pytest.mark.parametrize("window, overlap, reach", [(16, 6, 3), (9, 8, 4), (5, 0, 0), (1000, 10, 5), (41, 4, 2)])
def test_equals_the_whole_text(spark, window, overlap, reach):
    encoder = hashed_context_encoder(4, reach)
    got = {}
    for r in embed_long(frame(spark, TEXTS), "id", "text", encoder, window, overlap).collect():
        assert (r.id, r.pos) not in got
        got[r.id, r.pos] = r.vec
    want = {}
    for i, text in enumerate(TEXTS):
        tokens = re.findall(r"\w+|[^\w\s]", text or "")
        if tokens:
            want |= {(i, p): v for p, v in enumerate(encoder()([tokens])[0])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_no_call_is_longer_than_a_window_and_work_is_spread(spark):
    """A text of a million tokens."""
    df = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: i.cast("string")), " ").alias("text"))
    windows = token_windows(df, "id", text_tokens(F.col("text")), 512, 64)
    sizes = windows.select(F.size("tokens").alias("n"), (F.col("keep_to") - F.col("keep_from")).alias("kept")).agg(F.max("n"), F.sum("kept"), F.count("*")).first()
    assert tuple(sizes) == (512, 1_000_000, -(-(1_000_000 - 512) // 448) + 1)

    def make():
        def encode(windows):
            assert len(windows) <= 32 and max(map(len, windows)) <= 512
            return [np.ones((len(w), 1)) for w in windows]

        return encode

    rows = embed_long(df, "id", "text", make, tasks=8)
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 8 and sum(per_task) == 1_000_000 and max(per_task) < 200_000


def test_pooled(spark):
    rows = {r.id: r for r in embed_long_pooled(frame(spark, TEXTS), "id", "text", hashed_context_encoder(4, 2), 16, 4).collect()}
    whole = hashed_context_encoder(4, 2)()([[f"w{i % 17}" for i in range(200)]])[0]
    assert set(rows) == {2, 3, 4, 5, 6}
    assert np.allclose(rows[4].cls, whole[0]) and np.allclose(rows[4].mean, whole[1:-1].mean(axis=0)) and np.allclose(rows[4].max, whole[1:-1].max(axis=0))


def test_faults(spark):
    with pytest.raises(ValueError, match="overlap"):
        embed_long(frame(spark, TEXTS), "id", window=4, overlap=4)
    short = lambda: lambda windows: [np.ones((1, 2)) for _ in windows]
    with pytest.raises(Exception, match="vector per token"):
        embed_long(frame(spark, TEXTS), "id", make_fn=short).collect()


def test_pooled_by_runs(spark, monkeypatch):
    """Runs that end inside a window, against the rows of all tokens; texts that share an id, or have none, count as one."""
    monkeypatch.setattr("codepairs.operators.windowed.TOKEN_RUN", 30)
    encoder = hashed_context_encoder(4, 2)
    texts = [*enumerate(TEXTS), (4, "x y z"), (6, TEXTS[6]), (None, "p q r s"), (None, "t u"), (7, " ".join(f"v{i}" for i in range(61)))]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA)
    want = {r.id: r for r in pool_vectors(embed_long(df, "id", "text", encoder, 16, 4), "id", "pos", "vec", run=30).collect()}
    got = {r.id: r for r in embed_long_pooled(df, "id", "text", encoder, 16, 4).collect()}
    assert set(got) == set(want) == {2, 3, 4, 5, 6, 7, None}
    for i, row in want.items():
        for name in ("cls", "max", "mean"):
            assert (got[i][name] is None) == (row[name] is None)
            assert row[name] is None or np.allclose(got[i][name], row[name])
        assert i in (4, 6, None) or got[i] == row  # to the last digit


def test_pooled_shuffles_no_token_rows(spark):
    """Of a text of many tokens a row per run is shuffled."""
    df = spark.range(3).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("string")), " ").alias("text"))
    rows = embed_long(df, "id", "text", hashed_context_encoder(4, 2), 128, 8, tasks=3, run=4096)
    assert rows.count() == 3 * 5
    plan = embed_long_pooled(df, "id", "text", hashed_context_encoder(4, 2), 128, 8)._jdf.queryExecution().executedPlan().toString()
    assert "pos#" not in plan and "last_vec" in plan


def test_a_run_holds_few_vectors(spark):
    """Calls stay within the batch, and a run's windows are those of the whole text."""

    def make():
        def encode(windows):
            assert len(windows) <= 5 and max(map(len, windows)) <= 16
            return [np.array([[float(w[0][1:]), float(t[1:])] for t in w]) for w in windows]

        return encode

    df = frame(spark, [" ".join(f"t{i}" for i in range(n)) for n in (1, 15, 16, 17, 100, 333)])
    want = {(r.id, r.pos): r.vec for r in embed_long(df, "id", "text", make, 16, 6, batch_rows=5).collect()}
    for r in embed_long(df, "id", "text", make, 16, 6, batch_rows=5, run=40).collect():
        vectors = [want[r.id, p] for p in range(r.run * 40, r["last"] + 1)]
        assert r["last"] == (r.run + 1) * 40 - 1 or (r.id, r["last"] + 1) not in want
        body = np.array(vectors[1:] if r.run == 0 else vectors)
        assert r.cls == (vectors[0] if r.run == 0 else None) and r.last_vec == vectors[-1] and r.n_all == len(body)
        assert r.sum_all == (body.sum(axis=0).tolist() if len(body) else None)
        assert r.max_cut == (body[:-1].max(axis=0).tolist() if len(body) > 1 else None)
