import os
import types

import pytest
from pyspark.sql import functions as F

from codepairs import session


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    def fake(master, folder=None):
        conf = types.SimpleNamespace(get=lambda name, default: folder)
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId=f"app-{master}")
        return types.SimpleNamespace(conf=conf, sparkContext=context)

    assert session.scratch_dir(fake("yarn", "/shared")) == "/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(fake("yarn"))
    local = session.scratch_dir(fake("local[2]"))
    assert local == session.scratch_dir(fake("local[2]"))


def test_settle_cuts_the_plan_and_keeps_rows(spark):
    rows = spark.range(50).select("id", F.array(F.lit(1.5)).alias("v")).groupBy("id").agg(F.max("v").alias("v"))
    stored = session.settle(rows, "test")
    assert stored.schema.names == ["id", "v"]
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
    assert "Aggregate" not in stored._jdf.queryExecution().toString()


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(3)
    plan = lambda n: spark.range(9).join(session.bounded_broadcast(small, n), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(3).lower()
    assert "broadcast" not in plan(session.BROADCAST_ROWS + 1).lower()


def test_scratch_of_this_application_can_be_cleared(spark):
    stored = session.settle(spark.range(3), "gone")
    assert stored.count() == 3
    session.clear_scratch(spark)
    assert not os.path.exists(stored.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("bits", [session.SIEVE_MAP, session.SIEVE_BITS])
def test_sieve_keeps_all_that_is_wanted_and_little_else(spark, monkeypatch, bits):
    monkeypatch.setattr(session, "SIEVE_BITS", bits)
    rows = spark.range(-50_000, 50_000).select(F.when(F.col("id") != 7, F.col("id")).alias("key"))
    wanted = spark.range(-49_000, 50_000, 10).select(F.col("id").alias("of"))
    kept = [r.key for r in session.sieve(rows, F.col("key"), wanted, F.col("of")).collect()]
    assert set(range(-49_000, 50_000, 10)) <= set(kept) and len(kept) == len(set(kept)) and None not in kept
    assert len(kept) < (30_000 if bits > session.SIEVE_MAP else 50_000)
    assert session.sieve(rows, F.col("key"), wanted.limit(0), F.col("of")).count() == 0
