import hashlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codepairs.operators import sampling


def md5(*parts):
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def order(ids, *seed):
    return sorted(ids, key=lambda i: (md5(*seed, i), i))


@pytest.fixture
def rows(spark):
    """A third of the rows, and more, sit in one group."""
    return spark.range(600).select("id", F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("grp"))


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("seed", [1, 42])
def test_sample_per_group_is_the_first_k_by_digest(rows, digits, seed):
    got = sampling.sample_per_group(rows, "grp", ["hot", "g1"], 20, "id", seed, digits=digits).collect()
    hot = {r.id for r in got if r.grp == "hot"}
    assert hot == set(order(range(400), seed)[:20])
    assert {r.id for r in got if r.grp == "g1"} == set(order([i for i in range(400, 600) if i % 4 == 1], seed)[:20])
    assert len(got) == 40


def test_short_groups(rows):
    for groups in (["g1"], ["absent", "hot"]):
        with pytest.raises(PySparkException, match="too few rows"):
            sampling.sample_per_group(rows, "grp", groups, 60, "id").collect()
    assert sampling.sample_per_group(rows, "grp", ["g1", "absent"], 60, "id", strict=False).count() == 50
    assert sampling.sample_per_group(rows, "grp", ["g1"], None, "id").count() == 50
    assert sampling.sample_per_group(rows, "grp", ["g1"], 0, "id").count() == 50


def test_sample_n(rows, partitions):
    drawn = partitions(lambda: {r.id for r in sampling.sample_n(rows, 77, "id").collect()})
    assert drawn == [set(order(range(600), 42)[:77])] * 2
    with pytest.raises(PySparkException, match="too few rows"):
        sampling.sample_n(rows, 601, "id").collect()
    assert sampling.sample_n(rows, 601, "id", strict=False).count() == 600


@pytest.mark.parametrize("digits", [1, 4])
def test_seeded_shuffle(rows, digits):
    got = sampling.seeded_shuffle(rows, "id", batch=64, epoch=3, digits=digits).collect()
    by_position = [r.id for r in sorted(got, key=lambda r: r.position)]
    assert by_position == order(range(600), 42, 3)
    assert all(r.batch_id == r.position // 64 for r in got)
    other = sampling.seeded_shuffle(rows, "id", batch=64, epoch=4).orderBy("position").collect()
    assert [r.id for r in other] != by_position


def expected_draws(labels, node_type, use_size, seed):
    classes = {c: order([i for i, v in labels.items() if v == c], seed) for c in (0, 1)}
    half = min(len(classes[0]), len(classes[1]), use_size // 2)
    return [
        (node_type, i, f"text {pool[int(md5(seed, node_type, c, i)[:15], 16) % len(pool)]}", c)
        for c, pool in classes.items()
        for i in range(half)
    ]


@pytest.mark.parametrize(("use_size", "seed", "digits"), [(50, 42, 4), (51, 7, 1), (10_000, 42, 2)])
def test_balanced_sample(spark, use_size, seed, digits):
    labels = {t: {i: int(i % m == 0) for i in range(300)} for t, m in (("a", 3), ("b", 10))}
    rows = spark.createDataFrame([(i, f"text {i}", labels["a"][i], labels["b"][i], 0) for i in range(300)], "id int, text string, a int, b int, never int")
    got = [tuple(r) for r in sampling.balanced_sample(rows, ["a", "b", "never"], use_size, "id", seed=seed, digits=digits).collect()]
    assert sorted(got) == sorted(expected_draws(labels["a"], "a", use_size, seed) + expected_draws(labels["b"], "b", use_size, seed))
    sizes = Counter((t, c) for t, _, _, c in got)
    assert sizes["a", 0] == sizes["a", 1] and sizes["b", 0] == sizes["b", 1]


def test_balanced_sample_drops_other_labels(spark):
    rows = spark.createDataFrame([(1, "p", 1), (2, "n", 0), (3, "x", 2), (4, "y", None)], "id int, text string, a int")
    got = sampling.balanced_sample(rows, ["a"], 10, "id").collect()
    assert sorted((r.idx, r.sentence, r.label) for r in got) == [(0, "n", 0), (0, "p", 1)]


def test_repeated_ids_give_exactly_as_many_rows(spark, partitions):
    rows = [(7, f"t{i}", "a") for i in range(9)] + [(i, "u", "b") for i in range(5)] + [(3, "same", "c")] * 6
    df = spark.createDataFrame(rows, "id long, text string, grp string")
    for n in (1, 4, 9, 12, 20):
        got = partitions(lambda n=n: sorted(map(tuple, sampling.sample_n(df, n, "id").collect())))
        assert len(got[0]) == n and got[0] == got[1]
        assert all(got[0].count(r) <= rows.count(r) for r in got[0])
    per = sampling.sample_per_group(df, "grp", ["a", "b", "c"], 4, "id").collect()
    assert sorted(r.grp for r in per) == list("aaaabbbbcccc") and len({r.text for r in per if r.grp == "a"}) == 4
