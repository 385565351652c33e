"""Mixing against a plain version: targets by water level, takes near the targets."""

import hashlib
import random
import re

import pytest

from codepairs.llm.mixing import MAX_REPEATS, WEIGHTS, mix, mix_report

SCHEMA = "doc_id long, text string, source string, size string, hash string, repeats string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """``sizes`` by source; the excess over the caps is shared again until nothing exceeds one."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > MAX_REPEATS * sizes[s]}
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = float(MAX_REPEATS * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def order(doc_id, text):
    ident = f"17:{'-' if doc_id is None else doc_id}:{'-' if text is None else hashlib.md5(text.encode()).hexdigest()}"
    return int(hashlib.md5(ident.encode()).hexdigest()[:15], 16)


def check(rows, got):
    size = lambda t: len(WORD.findall(t or ""))
    by_source = {}
    for i, t, s in rows:
        by_source.setdefault(s, []).append((order(i, t), size(t), i))
    sizes = {s: sum(n for _, n, _ in docs) for s, docs in by_source.items()}
    want = targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    for s, docs in by_source.items():
        own = [r for r in got if r.source_size == sizes[s] and r.target == pytest.approx(want[s])]
        assert own
    for s, docs in by_source.items():
        ids = {i for _, _, i in docs}
        taken = [r for r in got if r.doc_id in ids]
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in taken)
        if len(ids) == len(docs):
            assert abs(sum(r.taken for r in taken) - want[s]) <= max(n for _, n, _ in docs) / 2 + 1e-6


def data(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "z", "B", "a", "\U0001f389", "src10", "src9"][: rng.randrange(2, 10)]
    rows = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([0, 3, 40, 400]))), rng.choice([*names, names[0]])) for i in range(250)]
    got = mix_report(data(spark, rows)).collect()
    check(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_report(data(spark, rows).repartition(7)).collect()))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\x0b", "b"), (4, "one word \x1cx", "c"), (5, "q " * 50_000, "d"), (6, "m n", None), (None, "u v w", "e"), (7, "k", "f")]
    rows += [(8, "same text", "g")] * 3
    got = mix_report(data(spark, rows)).collect()
    check(rows, got)
    assert {(r.doc_id, r.size) for r in got} >= {(1, 0), (2, 0), (3, 0), (4, 2), (5, 50_000), (None, 3)}


def test_empty(spark):
    assert mix_report(data(spark, [])).collect() == []
    assert mix(data(spark, [])).collect() == []


def test_rows_are_repeated_whole(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("x" for _ in range(rng.randrange(1, 30))), rng.choice("abc")) for i in range(120)]
    told = {r.doc_id: r.taken // r.size for r in mix_report(data(spark, rows)).collect()}
    mixed = mix(data(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size", "hash", "repeats"]
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert r.text == rows[r.doc_id][1]
    assert count == {i: n for i, n in told.items() if n}
