"""The quality model against a plain Kneser-Ney model, and on labelled documents it was not fitted on."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from codepairs.llm import quality
from codepairs.llm.quality import CALIBRATION_DOCS, PRIOR, Reader, gram_counts, keep_quality, kneser_ney, op10_quality, signed_words, trusted_documents

DOCS = "doc_id long, text string, lang string, kept string, perplexity string"
LABELS = "doc_id long, quality int, toxic int"
WHITE = " \t\n\x0b\x0c\r"


def tokens(text):
    words = "".join(" " if c in WHITE else c for c in text or "").split(" ")
    before = None
    for w in (w for w in words if w):
        stop = before is None or before[-1] in ".!?:"
        yield ("\n" if stop else "\t") + ("" if w == before else w) + " "
        before = w


def plain(texts, order=5):
    """Interpolated probabilities by recursion over counts."""
    top = collections.Counter()
    for t in texts:
        for w in tokens(t):
            for i in range(1, len(w)):
                top[w[max(0, i - order + 1) : i + 1]] += 1
    levels = {order: {g: c for g, c in top.items() if len(g) == order}}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
        levels[n].update({g: c for g, c in top.items() if len(g) == n})
    tables = {}
    for n, counts in levels.items():
        of = collections.Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else None
        cut = {k: 0.5 if y is None or not of[k] else min(k, max(0.05, k - (k + 1) * y * of[k + 1] / of[k])) for k in (1, 2, 3)}
        total, taken = collections.Counter(), collections.Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            taken[g[:-1]] += cut[min(c, 3)]
        tables[n] = (counts, cut, total, taken)
    kinds = max(256, len(levels[1]))

    def p(gram):
        if not gram:
            return 1 / kinds
        counts, cut, total, taken = tables[len(gram)]
        if gram[:-1] not in total:
            return p(gram[1:])
        c = counts.get(gram, 0)
        own = c - cut[min(c, 3)] if c else 0
        return (own + taken[gram[:-1]] * p(gram[1:])) / total[gram[:-1]]

    return lambda w: -sum(math.log(p(w[max(0, i - order + 1) : i + 1])) for i in range(1, len(w)))


def texts_of(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of.", "Water", "én", "rain!", "x", "🎉", "a:b", "\xa0", "and", "over"]
    return [rng.choice([" ", "\n", " \t"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_signs(spark):
    texts = [*texts_of(1, 60), "", None, " a  a a. a", ". x", ".", "a\x1cb c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", signed_words(F.col("text")).alias("w"))
    assert {r.i: r.w for r in df.collect()} == {i: list(tokens(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("order", [1, 3, 5])
def test_model_equals_plain_recursion(spark, order):
    texts = texts_of(2, 50)
    df = spark.createDataFrame([("", t) for t in texts], "lang string, text string")
    grams, contexts = kneser_ney(df, order)
    reader = Reader({r.gram: -math.log(r.p) for r in grams.collect()}, {r.context: -math.log(r.backoff) for r in contexts.collect()}, order)
    cost = plain(texts, order)
    for text in [*texts_of(3, 20), "unseen wörds here here", "ЖЖ"]:
        total, symbols = reader.text((text or "").encode())
        assert total == pytest.approx(sum(map(cost, tokens(text))), rel=1e-9)
        assert symbols == sum(len(w) - 1 for w in tokens(text))


def test_counts_are_of_all_symbols(spark):
    texts = texts_of(4, 30)
    df = spark.createDataFrame([("", t) for t in texts], "lang string, text string")
    assert gram_counts(df).agg(F.sum("count")).first()[0] == sum(len(w) - 1 for t in texts for w in tokens(t))


def corpus(spark, n=120):
    good = [(i, " ".join(t.split()) or "the of. Water", "en", "x", "y") for i, t in enumerate(texts_of(5, n))]
    junk = [(1000 + i, "".join(random.Random(i).choice("#%&ÄQ9") for _ in range(200)), "en", "x", "y") for i in range(5)]
    odd = [(2000, None, "en", "x", "y"), (2001, "", "en", "x", "y"), (2002, "%%%", "fr", "x", "y"), (2003, "the of. Water", None, "x", "y"), (None, "the and over", "en", "x", "y")]
    repeated = [(3000, "over " * 400, "en", "x", "y"), (3000, "over " * 400, "en", "x", "y"), (3001, "w" * 300_000, "en", "x", "y")]
    docs = spark.createDataFrame(good + junk + odd + repeated, DOCS)
    labels = [(i, 1, 0) for i in range(n)] + [(0, 0, 0), (1, None, 0), (2, 1, 1), (2, 1, 1), (None, 1, 0)]
    return docs, spark.createDataFrame(labels, LABELS)


def test_junk_goes_and_odd_rows_stay(spark):
    docs, labels = corpus(spark)
    kept = keep_quality(docs, labels, 1.0)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 2002 is junk in a language without trusted documents.
    assert not {i for i in ids if i is not None and (1000 <= i < 2000 or i >= 3000 or i == 2002)}
    assert set(ids) >= {2000, 2001, 2003, None} and len([i for i in ids if i is not None and i < 1000]) >= 118


def test_contradicting_labels_are_not_trusted(spark):
    docs, labels = corpus(spark)
    trusted = trusted_documents(docs, labels)
    assert trusted.count() == 118 and trusted.count() <= 2 * CALIBRATION_DOCS


def test_no_labels_and_no_documents(spark):
    docs, labels = corpus(spark)
    assert quality.quality(docs, labels.limit(0)).filter("kept").count() == docs.count()
    assert quality.quality(docs.limit(0), labels).collect() == []


def by_hand(docs, labels):
    """``(model, mean, limit)`` by language and, under None, of all languages together, from the plain model."""
    by_lang = collections.defaultdict(lambda: ([], []))
    for r in trusted_documents(docs, labels).collect():
        for lang in (r.lang, None):
            by_lang[lang][r.fit].append(r.text)
    limits = {}
    for lang, (held, fitted) in by_lang.items():
        if lang is not None and (len(held) < 10 or not fitted):
            continue
        cost = plain(fitted)
        told = [(sum(map(cost, tokens(t))), sum(len(w) - 1 for w in tokens(t))) for t in held]
        mean = sum(c for c, _ in told) / sum(n for _, n in told)
        scores = sorted(math.exp((c + PRIOR * mean) / (n + PRIOR)) for c, n in told)
        at = 0.998 * (len(scores) - 1)
        low, high = scores[int(at)], scores[min(int(at) + 1, len(scores) - 1)]
        limits[lang] = (cost, mean, low + (at - int(at)) * (high - low))
    return limits


def assert_by_hand(row, text, limits):
    cost, mean, limit = limits.get(row.lang or "", limits[None])
    n = sum(len(w) - 1 for w in tokens(text))
    assert row.perplexity == pytest.approx(math.exp((sum(map(cost, tokens(text))) + PRIOR * mean) / (n + PRIOR)), rel=1e-9)
    assert row.threshold == pytest.approx(limit, rel=1e-9) and row.kept == (row.perplexity <= row.threshold)


def test_query_by_hand(spark):
    """Perplexities and thresholds from the plain model, for languages with a model of their own and without."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    limits = by_hand(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op10_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    langs = {r.lang for r in rows}
    assert langs & set(limits) and langs - set(limits)
    for r in rows[::5]:
        assert_by_hand(r, texts[r.doc_id], limits)


def test_language_with_three_trusted_documents(spark):
    """It is judged by all languages together, and its junk goes; a null language likewise."""
    docs, labels = corpus(spark)
    few = [(4000 + i, "the rain! over and the Water", "xx", "x", "y") for i in range(3)] + [(4010, "#%&Q9" * 60, "xx", "x", "y"), (4011, "#%&Q9" * 60, None, "x", "y")]
    docs = docs.unionByName(spark.createDataFrame(few, DOCS))
    labels = labels.unionByName(spark.createDataFrame([(4000 + i, 1, 0) for i in range(3)], LABELS))
    rows = {r.doc_id: r for r in quality.quality(docs, labels).filter("doc_id >= 4000").collect()}
    assert [rows[i].kept for i in (4000, 4001, 4002, 4010, 4011)] == [True, True, True, False, False]
    limits = by_hand(docs, labels)
    texts = {r[0]: r[1] for r in few}
    assert "xx" not in limits
    for i, r in rows.items():
        assert_by_hand(r, texts[i], limits)


def windows_told(texts, order=5):
    parts = [(n, lead, part) for n, text in enumerate(texts) for lead, part in quality._parts(text)]
    signed, place, owner = quality._symbols([(lead, part) for _, lead, part in parts])
    owner, told, at = owner[place > 0], [collections.Counter() for _ in texts], 0
    for windows, which in quality._windows(signed, place, order):
        for w in which.tolist():
            told[parts[owner[at]][0]][windows[w]] += 1
            at += 1
    return told


@pytest.mark.parametrize("block", [7, 40, 500, 1 << 20])
def test_windows_of_blocks(monkeypatch, block):
    """Texts cut into parts give the windows of whole words, whatever the cuts and however wide the alphabet."""
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    rng = random.Random(9)
    wide = ["".join(chr(rng.randrange(0x3000, 0xD000)) for _ in range(7000)), " ".join(chr(rng.randrange(0x10000, 0x30000)) for _ in range(6000))]
    texts = [*texts_of(10, 60), "", "  ", "a a a. a a\n", *wide]
    want = [collections.Counter(w[max(0, i - 4) : i + 1] for w in tokens(t) for i in range(1, len(w))) for t in texts]
    assert windows_told([t.encode() for t in texts]) == want


def test_bunches_of_any_size(spark, monkeypatch):
    """Very long texts in parts, priced in many small bunches, cost what they cost whole."""
    docs, labels = corpus(spark)
    docs = docs.repartition(1)
    long = [(5000, " ".join(t for t in texts_of(11, 300)), "en", "x", "y")]
    docs = docs.unionByName(spark.createDataFrame(long, DOCS)).coalesce(1)
    limits, texts = by_hand(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    grams, contexts = kneser_ney(docs.limit(60).select(F.lit("=en").alias("lang"), "text"))
    rows = docs.select(F.lit("=en").alias("lang"), F.lit(b"k").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).filter("doc_id = 5000")
    reader = Reader({r.gram: -math.log(r.p) for r in grams.collect()}, {r.context: -math.log(r.backoff) for r in contexts.collect()}, 5)
    folder = quality.shared_uri(spark, "test-costs")
    batches = [b for b in rows.toArrow().select(["key", "lang", "text"]).to_batches()]
    for block, held in ((1 << 20, 1 << 25), (300, 900), (50, 10)):
        monkeypatch.setattr(quality, "BLOCK_BYTES", block)
        monkeypatch.setattr(quality, "HELD_BYTES", held)
        monkeypatch.setattr(quality, "HELD_WINDOWS", held)
        met = {w for b in quality._distinct(5)(iter(batches)) for w in b.column("window").to_pylist()}
        if block == 1 << 20:
            costs = [("=en", w, _last(reader, w)) for w in met]
            spark.createDataFrame(costs, "lang string, window string, cost double").write.parquet(folder)
        found = [r for b in quality._priced(folder, 5)(iter(batches)) for r in b.to_pylist()]
        total, symbols = reader.text(texts[5000].encode())
        assert sum(r["cost"] for r in found) == pytest.approx(total, rel=1e-9) and sum(r["symbols"] for r in found) == symbols
        assert sorted({r["part"] for r in found}) == list(range(len(found)))
    for r in quality.quality(docs, labels).collect():
        if r.doc_id in (5000, 3001):
            assert_by_hand(r, texts[r.doc_id], limits)


def _last(reader, window):
    """The cost of the last symbol of a window."""
    return reader.cost(window) - reader.cost(window[:-1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    told = op10_quality(spark, sf).join(labels, "doc_id")
    good, bad = (told.filter(F.col("quality") == q).agg(F.avg(F.col("kept").cast("double"))).first()[0] for q in (1, 0))
    assert good >= 0.98 and bad <= 0.1


def test_all_trusted_documents_count(spark):
    """More trusted documents than any cap: all are fitted on or held out, and the quantile is that of all held out."""
    texts = texts_of(8, 5000)
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], LABELS)
    parts = {True: [], False: []}
    for r in trusted_documents(docs, labels).collect():
        parts[r.fit].append(r.text)
    assert sorted(parts[True] + parts[False]) == sorted(texts) and min(map(len, parts.values())) > CALIBRATION_DOCS
    cost = plain(parts[True])
    told = [(sum(map(cost, tokens(t))), sum(len(w) - 1 for w in tokens(t))) for t in parts[False]]
    mean = sum(c for c, _ in told) / sum(n for _, n in told)
    scores = sorted(math.exp((c + PRIOR * mean) / (n + PRIOR)) for c, n in told)
    at = quality.QUANTILE * (len(scores) - 1)
    limit = scores[int(at)] + (at - int(at)) * (scores[int(at) + 1] - scores[int(at)])
    rows = quality.quality(docs, labels).select("threshold").distinct().collect()
    assert [r.threshold for r in rows] == [pytest.approx(limit, rel=1e-9)]
