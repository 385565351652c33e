"""Repeated byte strings against brute force, the cover, and the packing of names."""

import hashlib
import random

import numpy as np
import pytest

from codepairs.llm import suffix_dedup
from codepairs.llm.suffix_dedup import COVER, MODULUS, op3_suffix_dedup, pack, sampled, suffix_report, unpack

SCHEMA = "doc_id long, text string, n_bytes string, names string"


def brute(rows, width=100):
    """``rows`` with one text per id."""
    seen, out = {}, {}
    for i, t in sorted({r for r in rows if r[0] is not None}):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if seen.setdefault(data[s : s + width], (i, s)) != (i, s):
                gone[s : s + width] = b"\1" * width
        out[i] = gone
    told = []
    for i, t in rows:
        data = (t or "").encode()
        gone = out.get(i, bytes(len(data)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        told.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(told, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def data(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_the_cover_has_every_difference_once():
    differences = [(a - b) % MODULUS for a in COVER for b in COVER if a != b]
    assert sorted(differences) == list(range(1, MODULUS))


def test_every_two_places_have_a_common_sample():
    places = set(sampled(1000).tolist())
    for a in range(60):
        for b in range(0, 300, 7):
            assert any(a + k in places and b + k in places for k in range(MODULUS))


@pytest.mark.parametrize("top", [1, 300, 2**20, 2**41, 2**63])
def test_packing(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        if n == 5000:
            values[-1] = 2**64 - 1
        assert (unpack(pack(values)) == values).all()


def pieces(seed, n):
    """Texts cut from shared passages, at any offset, with letters of one and two bytes."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé \n") for _ in range(rng.choice([60, 99, 100, 101, 250, 900]))) for _ in range(6)] + ["ab" * 300, "a" * 400]
    rows = []
    for i in rng.sample(range(-30, 900), n):
        text = ""
        for _ in range(rng.randrange(6)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            text += part[a : a + rng.randrange(len(part))] if rng.random() < 0.6 else "".join(rng.choice("xyzü") for _ in range(rng.randrange(80)))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed, hot, flush", [(1, 4096, 4_000_000), (2, 2, 300), (3, 4096, 1000)])
def test_passages_at_any_offset(spark, monkeypatch, seed, hot, flush):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    rows = pieces(seed, 70)
    assert got(suffix_report(data(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    p = "".join(random.Random(5).choice("abcdefgh") for _ in range(400))
    rows = [(1, p), (2, None), (3, ""), (4, p[:99]), (5, p[7:107]), (6, p), (6, p), (None, p), (7, "é" * 120), (8, p[:150] + "-" + p[:150]), (9, "x" + p[1:])]
    rows += [(10, "z" * 100), (11, "z" * 101), (12, "q" * 3_000_00), (-5, p[300:])]
    assert got(suffix_report(data(spark, rows))) == brute(rows)


def test_several_texts_under_one_id(spark):
    rng = random.Random(6)
    p, q = ("".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(2))
    first, second = sorted((p, q), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = {r.kept_sha256: (r.doc_id, r.n_removed) for r in suffix_report(data(spark, [(1, second + "x"), (2, first), (2, second), (3, first + second)])).collect()}
    assert rows[hashlib.sha256(second.encode()).hexdigest()] in ((2, 0), (2, 200))
    assert len(rows) == 4 and sorted(i for i, _ in rows.values()) == [1, 2, 2, 3]


def test_empty(spark):
    assert suffix_report(data(spark, [])).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op3_suffix_dedup(spark, sf)) == brute(rows)


def test_sampled_places_of_several_texts():
    sizes = [0, 43, 44, 100, 57, 1000]
    places, text = suffix_dedup.sampled_of(np.cumsum([0, *sizes]))
    for i, n in enumerate(sizes):
        assert places[text == i].tolist() == sampled(n).tolist()


def test_names_make_rows_by_bunch_not_by_document():
    """A shard of names from 5,000 documents makes a row per bunch; all names come back by document."""
    rng = np.random.default_rng(3)
    value = np.sort(rng.integers(0, 1 << 40, 10_000, dtype=np.uint64).repeat(2))
    doc = rng.integers(-2500, 2500, 20_000)
    rows = suffix_dedup.pa.Table.from_pylist([suffix_dedup._shard_row(0, value, doc)], schema=suffix_dedup.PACKED)
    found = suffix_dedup._name(rows, 5, 8)
    assert len(found) <= 8
    got_ = set()
    for row in range(len(found)):
        for r in suffix_dedup._of_bunch(found.slice(row, 1), 5).to_pylist():
            got_ |= {(r["doc_id"], int(v)) for v in suffix_dedup._long(r["names"], 5)}
    assert got_ == set(zip(doc.tolist(), value.tolist(), strict=True))


def test_steps_that_are_done_leave_nothing_stored(spark, monkeypatch, tmp_path):
    """Only what the result is read from stays in the scratch folder."""
    from codepairs import session

    monkeypatch.setattr(session, "scratch_dir", lambda spark: str(tmp_path / "a b"))
    rows = pieces(4, 40)
    report = suffix_report(data(spark, rows))
    stored = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "a b").glob("codepairs/*/*")}
    assert not stored & {f"suffix-{x}" for x in ("names", "members", "folded", "contexts", "copies", "single", "runs")}
    assert "suffix-by-document" in stored
    assert got(report) == brute(rows)
