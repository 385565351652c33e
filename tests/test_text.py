import random
import re

import pytest
from pyspark.sql import functions as F

from codepairs.functions import text as X


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ('x = "#a"  # b', 'x = "'),
        ('"""a\nb"""\ny=1', "\ny=1"),
        ("'''a\nb'''y", "y"),
        ('"""open', '"""open'),
        ('a"""1"""b"""2"""c', "abc"),
        ("x # 'a\n'''doc # '''y", "x \ny"),
        ("a # tail\r still\nb", "a \nb"),
        ("", ""),
        ("# only", ""),
    ],
)
def test_strip_comments(one, code, expected):
    assert one(X.strip_comments(F.col("c")), "c string", code) == expected


def test_strip_comments_on_a_long_docstring(one):
    code = '"""' + "line of text\n" * 40_000 + '"""\nx = 1'
    assert one(X.strip_comments(F.col("c")), "c string", code) == "\nx = 1"


def test_patterns_agree_with_python_on_random_text(spark):
    rng = random.Random(11)
    pieces = ['"""', "'''", '"', "'", "#", "\n", "\r", "\t", " ", "a", "é", "\u2028", "\x1d", "=1"]
    codes = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, c string")
    got = rows.select("i", X.strip_comments(F.col("c")).alias("s"), X.flatten_ws(F.col("c")).alias("f"), X.token_count(F.col("c")).alias("n")).collect()
    for r in got:
        code = codes[r.i]
        stripped = re.sub("#.*", "", re.sub("(?s)'''.*?'''", "", re.sub('(?s)""".*?"""', "", code)))
        assert r.s == stripped
        assert r.f == re.sub(r"\s+", " ", code)
        assert r.n == len(re.findall(r"\w+|[^\w\s]", code))


def test_no_hash_survives(one):
    for code in ("#" * 50, "a#b\nc##d", '"""#"""#'):
        assert "#" not in one(X.strip_comments(F.col("c")), "c string", code)


@pytest.mark.parametrize("code", ["\na\t\tb \n", "", "  ", "a  b", "a\x1c\x1d\x85b", "a　b\r\nc"])
def test_flatten_ws_is_pythons_rule_and_idempotent(one, code):
    flat = one(X.flatten_ws(F.col("c")), "c string", code)
    assert flat == re.sub(r"\s+", " ", code)
    assert one(X.flatten_ws(F.col("c")), "c string", flat) == flat


@pytest.mark.parametrize("code", ["def f(x): return x+1", "", "é_1 + über", "a\n\n", "😀x"])
def test_tokens_are_pythons_rule(one, code):
    expected = re.findall(r"\w+|[^\w\s]", code)
    assert one(X.token_count(F.col("c")), "c string", code) == len(expected)
    assert one(X.truncate_tokens(F.col("c"), 3), "c string", code) == expected[:3]


def test_limits_count_code_points(one):
    inside = X.within_limits(F.col("c"), X.token_count(F.col("c")), 4, 2)
    assert one(inside, "c string", "ü 😀")
    assert not one(inside, "c string", "ü  😀x")
    assert not one(inside, "c string", "a b c")


def test_names(one):
    assert one(X.pooler_tag(F.col("p")), "p string", "m_cls-mean_2023") == "cls-mean"
    assert one(X.pooler_tag(F.col("p")), "p string", "out/max/m_cls") == "max-cls"
    assert one(X.pooler_tag(F.col("p")), "p string", "nothing") == ""
    flags = X.pooler_name(F.col("c"), F.col("x"), F.col("m"))
    assert one(flags, "c boolean, x boolean, m boolean", True, False, True) == "cls-mean"
    assert one(flags, "c boolean, x boolean, m boolean", False, False, False) == ""
    assert one(X.data_label(F.col("a")), "a array<string>", ["back_seq", "front_seq"]) == "back-seq-front-seq"
    name = X.report_name(F.lit("2023"), F.col("a"), F.col("p"))
    assert one(name, "a array<string>, p array<string>", ["all_point"], ["cls", "max"]) == "2023_all-point_cls-max.csv"
    assert one(X.pair_key(F.col("a"), F.col("b")), "a string, b string", "for", "if") == "for_if"
    assert one(X.cluster_name(F.col("c")), "c int", -1) == "noise"
    assert one(X.cluster_name(F.col("c")), "c int", 0) == "cluster-0"
    assert one(X.model_slug(F.col("c")), "c string", "a/b") == "a-b"


def test_paths(one):
    path = "/data/python/a.b.jsonl"
    assert one(X.path_dir(F.col("p")), "p string", path) == "python"
    assert one(X.path_file(F.col("p")), "p string", path) == "a.b.jsonl"
    assert one(X.path_stem(F.col("p")), "p string", path) == "a"
    assert one(X.path_dir(F.col("p")), "p string", "alone") is None
    assert one(X.decoded_uri(F.col("p")), "p string", "file:/a%20b/c+d") == "file:/a b/c+d"
