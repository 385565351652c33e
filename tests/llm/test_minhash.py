"""Near-duplicate documents against brute force; hashes and signatures on their own."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codepairs.llm import minhash
from codepairs.llm.hashing import shingle_sets, texts, word_hashes
from codepairs.llm.minhash import band_rows, drop_near_documents, near_documents, op9_minhash, shared, super_minhash

SCHEMA = "doc_id long, text string, digest string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                if min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    out = []
    for n, (i, _) in enumerate(rows):
        c = None if i is None else least[find(n)]
        out.append((i, len(sets[n]), c, i is None or c == i))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def data(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def variants(rng, groups, each, words=60):
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(rng.randrange(1, each)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(words)] = f"v{rng.randrange(4000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def test_groups(spark):
    rows = variants(random.Random(1), 40, 9)
    assert got(near_documents(data(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rows = variants(random.Random(2), 5, 60)
    assert got(near_documents(data(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "Älter ÄLTER"), (9, "Älter älter")]
    rows += [(10, "a b c"), (11, "a  B\tc"), (11, "a b c"), (11, "other text here now"), (None, "a b c"), (None, None), (12, long), (13, long + " x"), (14, "a\xa0b c d")]
    rows += [(15, "a b c a b c a b c"), (16, "b c a b c a b c a"), (17, "w" * 3_000_000)]
    assert got(near_documents(data(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_empty(spark):
    assert near_documents(data(spark, [])).collect() == []


def test_kept_documents_keep_their_columns(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, None), (8, "q")]
    kept = drop_near_documents(data(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "node"] and sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_rows_that_share_ids(spark):
    """A clean text that shares its id with a near copy stays; of equal rows one stays."""
    first, other = "a b c d e f g", "p q r s t u v"
    rows = [(1, first), (2, first.upper()), (2, other), (3, other), (3, other), (4, "x y z x y z"), (4, "x y z x y z"), (5, None), (5, None), (5, ""), (None, first), (None, first)]
    kept = drop_near_documents(data(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "node"]
    want = [(1, first), (2, other), (4, "x y z x y z"), (5, ""), (5, None), (None, first), (None, first)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op9_minhash(spark, sf)) == brute(rows, 3, 85)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingle_sets(size):
    rng = random.Random(size)
    rows = ["".join(rng.choice(["aB", "é", " ", "\n", "\x0b", "Zz", "\x1c", "中"]) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", " "]
    column = pa.array([None if r is None else r.encode() for r in rows], pa.binary())
    found = list(shingle_sets(*word_hashes(*texts(column)), size))
    assert [len(f) for f in found] == [len(shingles(r, size)) for r in rows]
    names = {}
    for own, r in zip(found, rows, strict=True):
        names.setdefault(own.tobytes(), set()).add(frozenset(shingles(r, size)))
    assert all(len(v) == 1 for v in names.values())


def test_pieces_do_not_change_hashes(monkeypatch):
    from codepairs.llm import hashing

    column = pa.array([b"some words and MORE of them", b"", b"x" * 90 + b" end"])
    whole = word_hashes(*texts(column))[0]
    monkeypatch.setattr(hashing, "PIECE", 8)
    assert (word_hashes(*texts(column))[0] == whole).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, keep in ((20, 0.5), (300, 0.8), (3000, 0.9)):
        error = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[: int(n * keep)], rng.integers(0, 2**63, n - int(n * keep), dtype=np.uint64)])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            error.append((super_minhash(a) == super_minhash(b)).mean() - true)
        assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


def test_bands_meet_almost_surely():
    for percent in (80, 85):
        r = band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (256 // r) <= 1e-5


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 400)).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]])
    assert (shared(sets[:10], sets[10:]) == want).all()
