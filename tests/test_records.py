import pytest

from codepairs.operators import records


def test_label_records(spark):
    schema = "repo string, path string, func_name string, language string, code string, subtree_elements_unique array<string>, extra int"
    rows = spark.createDataFrame([("r", "p", "f", "python", "x # y", ["if_statement"], 1)], schema)
    got = records.label_records(rows, ["for_statement", "if_statement"])
    assert got.columns == ["repo", "path", "func_name", "lang", "text", "for_statement", "if_statement"]
    assert tuple(got.first()) == ("r", "p", "f", "python", "x ", 0, 1)
    plain = records.project_rename(rows, keep=["extra"])
    assert plain.columns == ["repo", "path", "func_name", "lang", "text", "extra"]
    assert plain.first()["text"] == "x # y"


def test_route_edits(spark):
    schema = "original_code string, edited_code string, delete_target_node string, original_ast_node_types array<string>, edited_ast_node_types array<string>"
    rows = spark.createDataFrame(
        [
            ("o1", "e1", "if_statement", ["if_statement", "a"], ["a"]),
            ("o2", "e2", "block", ["block"], []),
            ("o3", "e3", "call", ["call", "if_statement"], ["if_statement"]),
            ("o4", "e4", "if_statement", ["if_statement"], ["if_statement"]),
        ],
        schema,
    )
    got = {r.original: r for r in records.route_edits(rows, ["if_statement"]).collect()}
    assert {k: r.bucket for k, r in got.items()} == {"o1": "target", "o3": "others"}
    # The flag describes the edited code.
    assert (got["o1"].if_statement, got["o3"].if_statement) == (0, 1)
    assert got["o1"].text == "e1"


def test_make_pairs(spark):
    rows = spark.createDataFrame([("f", 1, "a\n b", "a", 0.5, -0.5)], "file string, line int, cleaned_code string, edited_code string, cos_sim_diff_char double, cos_sim_diff_node double")
    assert tuple(records.make_pairs(rows).first()) == ("index", "a b", "a", 0.5)
    raw = records.make_pairs(rows, "ast", guid_cols=["file", "line"]).first()
    assert (raw.source, raw.label, len(raw.guid)) == ("a\n b", -0.5, 64)


@pytest.fixture
def nested(spark):
    schema = "filename string, original_code string, num_of_nodes bigint, edited_code array<struct<code:string,count:bigint>>"
    return spark.createDataFrame([("f", "src", 10, [("y", 1), ("w", 10)]), ("g", "src", 3, [])], schema)


def test_explode_edits(nested):
    got = records.explode_edits(nested).orderBy("num").collect()
    assert [(r.guid, r.source, r.target, r.label) for r in got] == [("f-0", "src", "y", -0.19), ("f-1", "src", "w", -1.0)]
    kept = {r.filename: r.pairs for r in records.explode_edits(nested, nested=True).collect()}
    assert [p.guid for p in kept["f"]] == ["f-0", "f-1"]
    assert kept["g"] == []


def test_melt_and_widen_are_inverse(spark):
    schema = "id int, `a` int, `a-inference` int, `b-c` int, `b-c-inference` int"
    wide = spark.createDataFrame([(1, 1, 0, 0, 0), (2, 0, 1, 1, 1)], schema)
    long = records.melt_by_type(wide, ["a", "b-c"], ["id"], {"actual": "", "inference": "-inference"})
    assert long.count() == 4
    back = records.widen_by_type(long, ["a", "b-c"], ["id"], ["actual", "inference"])
    assert back.columns == ["id", "a-actual", "a-inference", "b-c-actual", "b-c-inference"]
    assert sorted(tuple(r) for r in back.collect()) == [(1, 1, 0, 0, 0), (2, 0, 1, 1, 1)]


def test_split_and_limits_and_union(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None)], "id int, label int")
    assert sorted(r.id for r in records.split_by_label(rows).collect()) == [1, 2]
    codes = spark.createDataFrame([("a" * 800, 510), ("a" * 801, 1), ("a", 511)], "code string, token_count int")
    assert records.length_filter(codes).count() == 1
    swapped = rows.select("label", "id")
    assert sorted(r.id for r in records.union_sets(rows, swapped, rows).collect()) == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_row_operators_accept_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("r", "p", "f", "python", "x # y", ["if_statement"])], "repo string, path string, func_name string, language string, code string, subtree_elements_unique array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    labelled = records.label_records(stream, ["if_statement"])
    query = labelled.writeStream.format("memory").queryName("labelled").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("labelled").select("text", "if_statement").collect()] == [("x ", 1)]
