"""Files cut at every place against the whole file read at once."""

import itertools
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codepairs.sources import ranges
from codepairs.sources.ranges import CsvAutomaton, JsonAutomaton, cut
from codepairs.sources.readers import read_labelled_csv, read_nested_json


def states(automaton_type, pieces):
    """The state before each piece, by composing what each does to every state."""
    state, depth = automaton_type.begin
    out = []
    for piece in pieces:
        out.append((state, depth))
        end, more = automaton_type().outcomes(piece)[state]
        state, depth = end, depth + more
    return out


def cut_everywhere(tmp_path, data, automaton_type, kind, sizes=range(1, 12), chunk=None):
    file = tmp_path / "data"
    file.write_bytes(data)
    whole = list(cut(str(file), 0, len(data), automaton_type(kind), automaton_type.begin))
    for size in sizes:
        pieces = [data[i : i + size] for i in range(0, len(data), size)]
        found = []
        for i, state in enumerate(states(automaton_type, pieces)):
            found += cut(str(file), i * size, min(len(data), (i + 1) * size), automaton_type(kind), state, chunk or 3)
        assert found == whole, size
    return [r for _, r in whole if not automaton_type.empty(r)]


CSV = (
    'plain,a\n"quoted, ""twice""\nover\n\nlines",b\n"",c\n,d\nmid"quote,"e"\n"x""",f,extra\n"tail"rest,g\n"""",h\n"a\r\nb",i\r\n'
    '"""""",j\n"sp" ,k\n"last\n",l'
)


def test_csv_at_every_place(tmp_path):
    records = cut_everywhere(tmp_path, CSV.encode(), CsvAutomaton, "lines", range(1, len(CSV) + 2))
    assert len(records) == 12 and records[1] == b'"quoted, ""twice""\nover\n\nlines",b' and records[-1] == b'"last\n",l'


def test_csv_random(tmp_path):
    rng = random.Random(4)
    for _ in range(60):
        data = "".join(rng.choice('aé,"\n') for _ in range(60)).encode()
        cut_everywhere(tmp_path, data, CsvAutomaton, "lines", (1, 2, 5, 17), rng.choice([1, 2, 7]))


def json_text(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice('a\\"[]{},é\n\t') for _ in range(rng.randrange(7)))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return {"a\\": "\\\\", '"': "]}"}
    return [json_text(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {str(i): json_text(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 1])
def test_json_at_every_place(tmp_path, indent):
    rng = random.Random(5)
    for _ in range(25):
        items = [{"x": json_text(rng)} for _ in range(rng.randrange(5))]
        data = (rng.choice(["", " \n"]) + json.dumps(items, indent=indent, ensure_ascii=False) + rng.choice(["", "\n"])).encode()
        got = cut_everywhere(tmp_path, data, JsonAutomaton, "array", (1, 2, 3, 7, 19), rng.choice([1, 3, 50]))
        assert [json.loads(r) for r in got] == items
        whole = cut_everywhere(tmp_path, json.dumps({"all": items}).encode(), JsonAutomaton, "object", (1, 4, 30))
        assert [json.loads(r) for r in whole] == [{"all": items}]


def plain_csv(spark, path):
    """The one-task reader: the file whole."""
    rows = spark.read.schema("code string, label string, _corrupt_record string").csv(
        path, multiLine=True, escape='"', lineSep="\n", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )
    rows = rows.withColumns({"code": F.regexp_replace("code", "\r\n?", "\n"), "label": F.regexp_replace(F.regexp_replace("label", "\r$", ""), "\r\n?", "\n")})
    short = F.col("label").isNull() & F.col("_corrupt_record").isNotNull()
    return rows.select(F.coalesce("code", F.lit("")).alias("code"), F.when(short, None).otherwise(F.coalesce("label", F.lit(""))).alias("label"))


@pytest.mark.parametrize("split", [7, 64, 1000])
def test_csv_files_equal_the_one_task_reader(spark, tmp_path, split):
    rng = random.Random(split)
    words = ["x = 1", 'say "hi"', "a,b", "line\nbreak", "", " ", "é\r\nü", '"', "tab\t", "'"]
    for n in range(3):
        rows = [("".join(rng.choice(words) for _ in range(rng.randrange(4))), f"l{i}") for i in range(30)]
        text = "".join('"' + c.replace('"', '""') + f'",{lab}\n' if rng.random() < 0.9 else f"plain{n},{lab}\n" for c, lab in rows)
        (tmp_path / f"part{n}.csv").write_text(text + ("" if n else CSV), newline="")
    got = read_labelled_csv(spark, str(tmp_path), strict=False, split_bytes=split)
    want = plain_csv(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [(f"def f{i}():\n    return '{i}, \"\"{i}\"\"'\n", f"l{i % 7}") for i in range(4000)]
    path = tmp_path / "one.csv"
    path.write_text("".join(f'"{c}",{lab}\n' for c, lab in rows), newline="")
    split = path.stat().st_size // 20 + 1
    records = ranges.ranged_records(spark, str(path), CsvAutomaton, split)
    per_task = records.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 15 and max(r["count"] for r in per_task) < 4000 / 5
    got = read_labelled_csv(spark, str(path), split_bytes=split)
    assert sorted(map(tuple, got.collect())) == sorted((c.replace('""', '"'), lab) for c, lab in rows)


def test_short_rows_and_compressed_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(CSV.encode()))
    assert read_labelled_csv(spark, str(tmp_path / "a.csv.gz"), split_bytes=5).count() == 12
    (tmp_path / "b.csv").write_text('"a\nb",x\nalone\n')
    got = read_labelled_csv(spark, str(tmp_path / "b.csv"), strict=False, split_bytes=4)
    assert sorted(map(tuple, got.collect()), key=str) == [("a\nb", "x"), ("alone", None)]
    with pytest.raises(PySparkException, match="without a label"):
        read_labelled_csv(spark, str(tmp_path / "b.csv"), split_bytes=4).collect()


def nested(i):
    return {"filename": f"f{i}", "original_code": f'x = "{{[{i}" # \\ é\n', "num_of_nodes": i, "edited_code": [{"code": f"}}]{i}", "count": j} for j in range(i % 3)]}


@pytest.mark.parametrize("split", [9, 100, 10_000])
def test_json_files_at_some_splits(spark, tmp_path, split):
    items = [nested(i) for i in range(60)]
    (tmp_path / "many.json").write_text(json.dumps(items[:40]))
    (tmp_path / "pretty.json").write_text(json.dumps(items[40:55], indent=2, ensure_ascii=False))
    for i in range(55, 60):
        (tmp_path / f"one{i}.json").write_text(json.dumps(items[i]))
    (tmp_path / "none.json").write_text("[]\n")
    got = [r.asDict(recursive=True) for r in read_nested_json(spark, str(tmp_path), split_bytes=split).collect()]
    assert sorted(got, key=lambda r: r["num_of_nodes"]) == items


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "all.json"
    path.write_text(json.dumps([nested(i) for i in range(3000)]))
    records = ranges.ranged_records(spark, str(path), JsonAutomaton, path.stat().st_size // 20 + 1)
    per_task = records.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 15 and max(r["count"] for r in per_task) < 3000 / 5


def test_faulty_json(spark, tmp_path):
    good = json.dumps(nested(1))
    for name, text in (("cut", f"[{good}, {good[:-5]}"), ("bad", f"[{good}, {{nonsense}}]")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.json").write_text(text)
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_nested_json(spark, str(folder), split_bytes=50).collect()
        rows = read_nested_json(spark, str(folder), strict=False, split_bytes=50).collect()
        assert sorted(r["filename"] or "" for r in rows) == ["", "f1"] or name == "cut"
        assert any(r["_corrupt_record"] for r in rows)


def test_pieces_of_nothing():
    for kind, empty in itertools.product((CsvAutomaton, JsonAutomaton), (b"",)):
        assert kind().outcomes(empty) == [(s, 0) for s in range(kind.states)]
        assert kind().separators(empty, kind.begin) == ([], kind.begin)


def test_json_is_scanned_once_for_all_states(monkeypatch):
    """A chunk is gone through once, or twice where it may begin behind a backslash; every outcome is that of a scan of its own."""
    calls, scan = [], JsonAutomaton._scan
    monkeypatch.setattr(JsonAutomaton, "_scan", lambda self, data, escaped: calls.append(escaped) or scan(self, data, escaped))
    tool = JsonAutomaton()
    text = json.dumps([nested(i) for i in range(4)]).encode()
    for start in range(len(text)):
        calls.clear()
        got = tool.outcomes(text[start:])
        assert len(calls) == (2 if text[start] in b'"\\' else 1)
        assert got == [tool.separators(text[start:], (state, 0))[1] for state in range(3)]
