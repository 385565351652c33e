"""Line dedup against brute force over all pairs of lines."""

import random

import pytest

from codepairs.llm.line_dedup import drop_lines, line_report

SCHEMA = "doc_id long, text string, n_chars long, digest string, pos string"


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def split(line):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in line).split(" ") if w]


def brute(rows):
    lines = [(i, p, split(x)) for i, t in rows if t is not None and i is not None for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    out = []
    for i, t in rows:
        gone = []
        for p, x in enumerate(t.split("\n") if t is not None else []):
            w = split(x)
            if i is not None and w and any((j, q) < (i, p) and (v == w or (min(len(v), len(w)) >= 5 and near(w, v))) for j, q, v in lines):
                gone.append(p)
        out.append((i, 0 if t is None else len(t.split("\n")), len(gone), ",".join(map(str, gone))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in df.collect()), key=str)


def data(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def random_docs(seed, docs, words):
    rng = random.Random(seed)
    lines = [[rng.choice(words) for _ in range(rng.randrange(3, 22))] for _ in range(25)]

    def line():
        w = list(rng.choice(lines))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        return rng.choice([" ", "  ", "\t"]).join(w)

    return [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in rng.sample(range(-50, 500), docs)]


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    rows = random_docs(seed, 60, ["a", "b", "c"] if seed else [f"w{i}" for i in range(50)] + ["é"])
    assert got(line_report(data(spark, rows))) == brute(rows)


def test_both_ways_to_variants(spark, monkeypatch):
    from codepairs.llm import line_dedup

    monkeypatch.setattr(line_dedup, "USUAL_WORDS", 11)
    rows = random_docs(7, 60, ["a", "b", "c", "d"])
    assert got(line_report(data(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(20_000))
    rows = [(1, "a b c d e"), (2, "a b c d"), (3, None), (4, ""), (5, "\n \n"), (6, "  a  b c\td e \nx"), (7, "a b c d e f\na b c d f f"), (None, "a b c d e"), (None, "q r s t u")]
    rows += [(8, long), (9, long + " more"), (9, long.replace("z77 ", "")), (10, "q r s t u"), (10, "q r s t u"), (11, "q r s t u\r"), (12, "1 2 3 4 5\n" * 3000)]
    assert got(line_report(data(spark, rows))) == brute(rows)


def test_short_lines(spark):
    """Equal ones go, whatever their length; near ones are compared from five words on."""
    rows = [(1, "All rights reserved.\nx\n\na b c d"), (2, " All  rights reserved.\r\ny\n\na b c e\na b c d"), (3, "x"), (4, "a b c d z"), (None, "x")]
    assert brute(rows)[1] == (2, 5, 2, "0,4")
    assert got(line_report(data(spark, rows))) == brute(rows)


def test_empty(spark):
    assert line_report(data(spark, [])).collect() == []
    assert drop_lines(data(spark, [])).collect() == []


def test_documents_without_their_lines(spark):
    rows = [(1, "a b c d e\nkeep this"), (2, "a b c d x\nother"), (3, "a b c d e"), (4, None), (5, " "), (6, "end\na b q c d e")]
    kept = drop_lines(data(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_chars", "digest", "pos"]
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {1: (rows[0][1], 19), 2: ("other", 5), 4: (None, 0), 5: (" ", 1), 6: ("end", 3)}


def test_unrelated_line_of_equal_first_sum(spark):
    """Four words whose sum of word hashes is that of four others: the earlier line of that sum may not hide the near one."""
    other, mine = (" ".join(f"v{i}" for i in w) for w in ([18, 1, 46, 6], [23, 67, 41, 16]))
    rows = [(1, f"{other} x"), (2, "v18 v1 p q r"), (3, f"{mine} y"), (4, f"{mine} z")]
    assert brute(rows)[3] == (4, 1, 1, "0")
    assert got(line_report(data(spark, rows))) == brute(rows)


def test_texts_without_wanted_lines_are_not_shuffled(spark, monkeypatch):
    """What is joined by document, by line or by variant goes through a sieve first, and no link is lost by it."""
    from codepairs.llm import line_dedup

    plans, settle = {}, line_dedup.settle

    def told(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    monkeypatch.setattr(line_dedup, "settle", told)
    rows = [(i, "\n".join(f"u{i} v{j} w{i} x{j} y{i}" for j in range(3))) for i in range(300)] + [(300, "a b c d e"), (301, "a b c x e")]
    rows.append((302, rows[7][1]))
    assert got(line_report(data(spark, rows))) == brute(rows)
    for name in ("lines-texts", "lines-met", "lines-both", "lines-marked", "lines-gone", "lines-active"):
        assert "LeftSemi" in plans[name], name
