"""Window packing: ids against the tokenizer file's own library, the solver against brute force, an exact round trip."""

import itertools
import random
import zlib

import numpy as np
import pytest

from codepairs.llm.windows import ByteEncoder, combinations, op12_windows, pack_windows, repeats, rounded, solve, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, sequence_id string, length string"


def test_ids_equal_those_of_the_file():
    encoder = ByteEncoder(tokenizer_file())
    assert encoder.fast is not None
    rng = random.Random(3)
    alphabet = "abcÄéßñ'stré  \x1c\x85 \n\t\r0129#%­Σİ中文🎉ⅷ²ǅः्‍ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "it's  THEY'LL\n\n x", " a <|endoftext|> b<|endoftext|>", "\n" * 5000 + "x", "a" * 30000, "!?" * 20000, " " * 50000]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids, text[:80]


def test_other_files_are_encoded_by_their_own_library():
    encoder = ByteEncoder(tokenizer_file("word_bpe_49k.json"))
    assert encoder.fast is None
    assert encoder.encode("Some Words").tolist() == encoder.slow.encode("Some Words", add_special_tokens=False).ids


def test_very_long_runs():
    encoder = ByteEncoder(tokenizer_file())
    for text in (" " * 1_500_000, "x " * 300_000, "ab" * 100_000):
        assert len(encoder.encode(text)) > 0


@pytest.mark.parametrize("window, depth", [(12, 3), (16, 2), (9, 1), (20, 4)])
def test_combinations(window, depth):
    rng = random.Random(window)
    lengths = sorted(rng.sample(range(1, window + 1), window // 2))
    want = {(0,) * (depth - n) + c for n in range(1, depth + 1) for c in itertools.combinations_with_replacement(lengths, n) if sum(c) == window}
    got = combinations(np.array(lengths), window, depth)
    assert {tuple(r) for r in got.tolist()} == want and len(got) == len(want)


def test_solver_finds_what_can_be_met_exactly():
    rng = np.random.default_rng(1)
    combos = combinations(np.arange(1, 64), 64)
    histogram = np.zeros(65)
    for i in rng.choice(len(combos), 40, replace=False):
        np.add.at(histogram, combos[i][combos[i] > 0], 1000)
    x = repeats(combos, histogram, 2000)
    used = np.zeros(65)
    for j in range(3):
        np.add.at(used, combos[:, j], x)
    assert (x >= 0).all() and np.abs(used - histogram)[1:].max() < 1
    times = rounded(combos, x, histogram)
    whole = np.zeros(65, dtype=int)
    for j in range(3):
        np.add.at(whole, combos[:, j], times)
    assert (whole[1:] <= histogram[1:]).all() and whole[1:].sum() > 0.95 * histogram.sum()


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_token_once(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 32, 50])
    counts = {n: rng.choice([1, 5, 300]) for n in rng.sample(range(1, window), rng.choice([1, 3, window - 1]))}
    plan = solve(counts, window)
    sequences = {}
    for length, many in counts.items():
        for rank in range(many):
            parts = plan.parts(length, rank)
            at = 0
            for start, size, sequence, offset in parts:
                assert start == at and size > 0
                at += size
                sequences.setdefault(sequence, []).append((offset, size))
            assert at == length
    check_sequences(sequences, window)
    assert set(sequences) == set(range(plan.sequences))


def check_sequences(sequences, window):
    sizes = []
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    short = [n for n in sizes if n < window]
    assert all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))
    return sizes


def check(docs, rows, window=1024, end_id=0):
    encoder = ByteEncoder(tokenizer_file())
    whole = {}
    for doc_id, text in docs:
        ids = np.array([*encoder.slow.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        whole.setdefault(doc_id, []).append(ids)
    found, sequences = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(found) == set(whole)
    for doc_id, texts in whole.items():
        copies = len(texts)
        assert all(len(t) == len(texts[0]) for t in texts)
        assert sum(r.length for r in found[doc_id]) == sum(map(len, texts))
        for r in found[doc_id]:
            part = texts[0][r.start : r.start + r.length].tobytes()
            assert r.length > 0 and r.doc_tokens == len(texts[0]) and copies
            if hasattr(r, "ids"):
                assert bytes(r.ids) == part
            else:
                assert r.ids_crc32 == zlib.crc32(part)
        # Every id in as many pieces as there are copies.
        depth = np.zeros(len(texts[0]) + 1, dtype=int)
        for r in found[doc_id]:
            depth[r.start] += 1
            depth[r.start + r.length] -= 1
        assert (np.cumsum(depth)[:-1] == copies).all()
    return check_sequences(sequences, window)


def test_edge_rows(spark, partitions):
    docs = [(1, "Word and other " * 3000), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "b c"), (5, "x" * 20000), *[(n, "same text here " * (n % 7)) for n in range(10, 400)]]
    df = spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in docs], SCHEMA)
    for rows in partitions(lambda: pack_windows(df, tokenizer_file()).collect()):
        check(docs, rows)
    check(docs, pack_windows(df, tokenizer_file(), window=50, end_id=9).collect(), 50, 9)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pack_windows(df, tokenizer_file()).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_windows(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    sizes = check(docs, rows)
    assert len(sizes) <= sum(sizes) // 1024 + 11
    # Most documents that fit a window are not cut.
    short = [r for r in rows if r.doc_tokens <= 1024]
    assert sum(r.length < r.doc_tokens for r in short) < len(short) / 2
