"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The symbols are characters. A word is read from a start sign, which tells
whether the word before ended a sentence, to an end sign; a word that repeats
the one before is the end sign alone, so running repetition costs one unlikely
symbol each time instead of many likely ones. N-grams reach back to the start sign at most.

Counts, continuation counts, discounts and back-off weights are aggregates and
joins over shards of the n-grams of all trusted documents but those held out for
the quantile, order by order. The distinct windows of the corpus (a symbol and those
before it) meet the sharded n-grams and become a stored table of costs. Texts are
neither stored nor shuffled: they are read a second time, and a task that holds a
bounded bunch of texts as numbers of windows goes through the costs of their
languages batch by batch and adds them up. Neither model nor texts pass through the
driver, and no number of documents is bounded.

A language with fewer than ten held-out documents, or none to fit on, is judged by the model
and the quantile of the trusted documents of all languages together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codepairs.llm.registry import query, table
from codepairs.llm.warc import open_uri, shared_uri
from codepairs.session import settle

ORDER = 5
CALIBRATION_DOCS = 2000  # bounds nothing any more; a test of a small corpus measures by it
LEAST_CALIBRATION = 10  # held-out documents; a language with fewer is judged by all languages together
QUANTILE = 0.998
PRIOR = 100  # symbols at the language's mean that every document is given, as short ones vary more
SYMBOLS = 256  # least size of the alphabet over which the lowest order is evened out

# Signs that no word holds: the start of a word after the end of a sentence and elsewhere, and the end of a word.
AFTER_STOP, AFTER_WORD, END = "\n", "\t", " "
STOPS = ".!?:"
STOP_BYTES = frozenset(STOPS.encode())
SPACE = re.compile(rb"[\x20\x09-\x0D]")
POOL = "*"  # the model of all languages together; that of a language is named by "=" and the language
BLOCK_BYTES = 1 << 20  # of text worked on at once
HELD_BYTES = 32 << 20  # of text whose symbols a task holds as numbers of windows, four bytes each
HELD_WINDOWS = 1_000_000  # distinct windows that a task remembers, give or take a block
BATCH_ROWS = 65_536
BUCKETS = 65536  # of the logarithm of a perplexity, for each e-fold


def signed_words(text: Column) -> Column:
    """The words of a text (runs other than space and tab to carriage return) with their signs, as an array."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Before the first word stands a full stop, which also makes the second list longer by one.
    pairs = F.filter(F.arrays_zip(words.alias("word"), F.concat(F.array(F.lit(". ")), words).alias("before")), lambda p: p["word"].isNotNull())

    def signed(pair: Column) -> Column:
        word, before = pair["word"], pair["before"]
        stop = (before == ". ") | F.substring(before, -1, 1).isin(*STOPS)
        return F.concat(F.when(stop, F.lit(AFTER_STOP)).otherwise(F.lit(AFTER_WORD)), F.when(word == before, F.lit("")).otherwise(word), F.lit(END))

    return F.transform(pairs, signed)


def gram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, count``: for every symbol the longest n-gram that ends in it."""
    tokens = trusted.select("lang", F.explode(signed_words(F.col("text"))).alias("token")).groupBy("lang", "token").count()
    ends = tokens.withColumn("at", F.explode(F.sequence(F.lit(2), F.length("token"))))
    start = F.greatest(F.col("at") - (order - 1), F.lit(1))
    return ends.groupBy("lang", F.substr("token", start, F.col("at") - start + 1).alias("gram")).agg(F.sum("count").alias("count"))


def _discounts(grams: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: what modified Kneser-Ney takes from counts of one, of two, and of more.

    Where the counts of counts run out it is a half; otherwise at least a twentieth, and no more than the count.
    """
    n = {k: F.count(F.when(F.col("count") == k, 1)).cast("double") for k in (1, 2, 3, 4)}
    few = grams.groupBy("lang").agg(*[c.alias(f"n{k}") for k, c in n.items()])
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def taken(k: int) -> Column:
        d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        return F.when(d.isNull(), F.lit(0.5)).otherwise(F.least(F.greatest(d, F.lit(0.05)), F.lit(float(k)))).alias(f"d{k}")

    return few.select("lang", taken(1), taken(2), taken(3))


def kneser_ney(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """``(lang, gram, p)`` of all n-grams seen and ``(lang, context, backoff)``, stored.

    N-grams of less than the full order count the symbols that they were seen
    after, except those that begin with a start sign: nothing stands before
    them, and they keep their number. The empty n-gram has the share of a symbol never seen.
    """
    raw = settle(gram_counts(trusted, order), "kn-grams")
    levels: dict[int, DataFrame] = {}
    for n in range(order, 0, -1):
        own = raw.filter(F.length("gram") == n)
        if n < order:
            own = own.unionByName(levels[n + 1].groupBy("lang", F.substr("gram", F.lit(2)).alias("gram")).agg(F.count("*").alias("count")))
        levels[n] = settle(own, "kn-counts")
    kinds = F.greatest(F.count("*"), F.lit(SYMBOLS))
    lower = settle(levels[1].groupBy("lang").agg((1 / kinds).alias("p")).select("lang", F.lit("").alias("gram"), "p"), "kn-level")
    grams, contexts = lower, None
    for n in range(1, order + 1):
        counted = levels[n].join(settle(_discounts(levels[n]), "kn-discounts"), "lang")
        cut = F.when(F.col("count") == 1, F.col("d1")).when(F.col("count") == 2, F.col("d2")).otherwise(F.col("d3"))
        counted = counted.select("lang", "gram", "count", cut.alias("cut"), F.substr("gram", F.lit(1), F.lit(n - 1)).alias("context"), F.substr("gram", F.lit(2)).alias("tail"))
        sums = settle(counted.groupBy("lang", "context").agg(F.sum("count").alias("total"), F.sum("cut").alias("taken")), "kn-contexts")
        below = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
        joined = counted.join(sums, ["lang", "context"]).join(below, ["lang", "tail"])
        p = (F.col("count") - F.col("cut") + F.col("taken") * F.col("lower")) / F.col("total")
        lower = settle(joined.select("lang", "gram", p.alias("p")), "kn-level")
        grams = grams.unionByName(lower)
        weights = sums.select("lang", "context", (F.col("taken") / F.col("total")).alias("backoff"))
        contexts = weights if contexts is None else contexts.unionByName(weights)
    return grams, contexts


class Reader:
    """Scores texts by the costs (negative logarithms) of n-grams and of backing off, held in memory; what the joins add up to."""

    def __init__(self, grams: dict[str, float], contexts: dict[str, float], order: int):
        self.grams, self.contexts, self.order = grams, contexts, order

    def cost(self, token: str) -> float:
        """Of a word with its signs."""
        grams, contexts, total = self.grams, self.contexts, 0.0
        for at in range(1, len(token)):
            for start in range(max(0, at - self.order + 1), at + 1):
                found = grams.get(token[start : at + 1])
                if found is not None:
                    total += found
                    break
                total += contexts.get(token[start:at], 0.0)
            else:
                total += grams[""]
        return total

    def text(self, text: bytes) -> tuple[float, int]:
        """Cost and number of symbols."""
        counts = word_counts(text)
        tokens = [(as_token(w, stop), n) for (w, stop), n in counts.items()]
        return sum(self.cost(t) * n for t, n in tokens), sum((len(t) - 1) * n for t, n in tokens)


def word_counts(text: bytes) -> Counter:
    """How often each word, by whether it begins a sentence, stands in a text; empty for one that repeats the one before."""
    words = text.split()
    before = [b".", *words[:-1]]
    stops = [w[-1] in STOP_BYTES for w in before]
    if words:
        before[0] = b""  # the first word repeats nothing
    return Counter(zip([b"" if w == x else w for w, x in zip(words, before, strict=False)], stops, strict=False))


def as_token(word: bytes, stop: bool) -> str:
    return (AFTER_STOP if stop else AFTER_WORD) + word.decode("utf-8", "replace") + END


def _trusted_ids(labels: DataFrame) -> DataFrame:
    """``_id, fit``: the documents labelled good, parted by a digest of their ids."""
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_worst")).filter("_worst = 1 and _id is not null")
    return good.select("_id", (F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(2)) == 0).alias("fit"))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``lang, text, fit``: all documents labelled good; about one in two, by a digest of its id, is fitted on, the others are held out.

    Ids with contradicting labels, or a null one, are not trusted. A null
    language is a language of its own.
    """
    return _trusted(docs, _trusted_ids(labels))


def _trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    pair = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), docs["text"].alias("text"))
    return pair.join(ids, F.col("doc_id") == F.col("_id")).select("lang", "text", "fit")


def _key(lang: Column, text: Column) -> Column:
    """A digest of language and text, of which a verdict is a function."""
    lang = F.coalesce(lang, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(lang).cast("string"), F.lit(":"), lang, F.coalesce(text, F.lit("")))))


def _parts(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A text in runs of whole words of about a block, each with the word before it (empty at the start)."""
    at, lead = 0, b""
    while len(text) - at > BLOCK_BYTES and (cut := SPACE.search(text, at + BLOCK_BYTES)):
        part = text[at : cut.start()]
        yield lead, part
        lead = (part.rsplit(None, 1) or [lead])[-1]
        at = cut.start()
    yield lead, text[at:]


def _symbols(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signed words of some parts one after another: the symbols, the place of each in its word, and the number of its part."""
    texts = [(lead + b" " + part).decode("utf-8", "replace") for lead, part in parts]
    joined = "\n".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = ~((chars == 32) | ((chars >= 9) & (chars <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    part = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), low, side="right") - 1
    size = high - low
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = part[1:] != part[:-1]
    stop = fresh.copy()
    stop[1:] |= np.isin(chars[high[:-1] - 1], [ord(c) for c in STOPS])
    again = ~fresh
    again[1:] &= (size[1:] == size[:-1]) & (chars[low[1:]] == chars[low[:-1]]) & (chars[high[1:] - 1] == chars[high[:-1] - 1])
    for i in np.flatnonzero(again).tolist():
        again[i] = joined[low[i] : high[i]] == joined[low[i - 1] : high[i - 1]]
    # The word before a part is told in the part it belongs to.
    own = ~(fresh & np.array([lead != b"" for lead, _ in parts], dtype=bool)[part])
    low, stop, part, size = low[own], stop[own], part[own], np.where(again, 0, size)[own]
    many = size + 2
    start = np.cumsum(many) - many
    signed = np.empty(int(many.sum()), dtype=np.uint32)
    signed[start] = np.where(stop, ord(AFTER_STOP), ord(AFTER_WORD))
    signed[start + many - 1] = ord(END)
    # Symbols of words stand in the order of their characters.
    moved = np.arange(int(size.sum())) + np.repeat(start + 1 - (np.cumsum(size) - size), size)
    signed[moved] = chars[moved + np.repeat(low - start - 1, size)]
    place = np.arange(len(signed), dtype=np.int32) - np.repeat(start.astype(np.int32), many)
    return signed, place, np.repeat(part.astype(np.int32), many)


def _windows(signed: np.ndarray, place: np.ndarray, order: int, skip: int = 0, numbered: bool = True) -> Iterator[tuple[list[str], np.ndarray | None]]:
    """Distinct windows, and, if ``numbered``, the number of the window of each symbol that is no start sign, from ``skip`` on.

    Symbols are numbered and a window is one whole number; where they are too many for that, each half is done alone.
    """
    seen = np.zeros(int(signed.max()) + 1 if len(signed) else 1, dtype=bool)
    seen[signed] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    bits = len(alphabet).bit_length()
    if bits * order > 63:
        middle = (skip + len(signed)) // 2
        yield from _windows(signed[:middle], place[:middle], order, skip, numbered)
        ahead = max(0, middle - order + 1)
        yield from _windows(signed[ahead:], place[ahead:], order, middle - ahead, numbered)
        return
    number = np.cumsum(seen)[signed]
    code = number.copy()
    for back in range(1, order):
        before = np.zeros_like(number)
        before[back:] = number[:-back]
        before[place < back] = 0
        code |= before << (bits * back)
    code = code[skip:][place[skip:] > 0]
    which, codes = pd.factorize(code) if numbered else (None, np.unique(code))
    digits = (codes[:, None] >> (bits * np.arange(order - 1, -1, -1))) & ((1 << bits) - 1)
    told = np.empty(len(codes), dtype=object)
    lengths = (digits > 0).sum(axis=1)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        run = alphabet[digits[rows, order - n :] - 1].tobytes().decode("utf-32-le", "surrogatepass")
        told[rows] = [run[i : i + n] for i in range(0, len(run), n)]
    yield told.tolist(), which


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[bytes, int, bytes, bytes]]]]:
    """Bunches of parts of texts of one language, of about a block, each with the key of its text and its number there."""
    held: dict[str, list] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for key, lang, text in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True):
            for serial, (lead, part) in enumerate(_parts(text)):
                held.setdefault(lang, []).append((key, serial, lead, part))
                sizes[lang] += len(part) + 64
                if sizes[lang] >= BLOCK_BYTES:
                    sizes[lang] = 0
                    yield lang, held.pop(lang)
    yield from held.items()


def _distinct(order: int):
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``lang, window`` of all symbols; a task repeats a window only if it has met very many others."""
        met: dict[str, set[str]] = {}
        for lang, block in _blocks(batches):
            signed, place, _ = _symbols([(lead, part) for _, _, lead, part in block])
            for told, _ in _windows(signed, place, order, numbered=False):
                if sum(map(len, met.values())) >= HELD_WINDOWS:
                    met.clear()
                seen = met.setdefault(lang, set())
                new = [w for w in told if w not in seen]
                seen.update(new)
                for at in range(0, len(new), BATCH_ROWS):
                    some = new[at : at + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string())], ["lang", "window"])

    return distinct


class _Held:
    """Texts of a task as numbers of windows, until their costs are known."""

    def __init__(self):
        self.numbers: dict[str, dict[str, int]] = {}
        self.blocks: list[tuple[str, list[tuple[bytes, int]], np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, lang: str, block: list[tuple[bytes, int, bytes, bytes]], order: int) -> None:
        signed, place, part = _symbols([(lead, text) for _, _, lead, text in block])
        numbers, found = self.numbers.setdefault(lang, {}), []
        for told, which in _windows(signed, place, order):
            found.append(np.array([numbers.setdefault(w, len(numbers)) for w in told], dtype=np.int32)[which])
        many = np.bincount(part[place > 0], minlength=len(block))
        self.blocks.append((lang, [(key, serial) for key, serial, _, _ in block], many, np.concatenate(found)))
        self.bytes += sum(len(text) for _, _, _, text in block)

    def full(self) -> bool:
        return self.bytes >= HELD_BYTES or sum(map(len, self.numbers.values())) >= HELD_WINDOWS

    def priced(self, folder: str) -> Iterator[pa.RecordBatch]:
        """``lang, key, part, cost, symbols`` of the parts held."""
        costs = {lang: np.full(len(numbers), np.nan) for lang, numbers in self.numbers.items()}
        store, name = open_uri(folder)
        table_of = pa.dataset.dataset(name, filesystem=store, format="parquet")
        batches = table_of.to_batches(
            columns=["lang", "window", "cost"], filter=pa.dataset.field("lang").isin(list(costs)), batch_size=BATCH_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False
        )
        for batch in batches:
            found = batch.column("cost").to_numpy(zero_copy_only=False)
            langs = batch.column("lang").dictionary_encode()
            for at, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(langs.indices.to_numpy() == at)
                numbers = self.numbers[lang]
                which = np.array([numbers.get(w, -1) for w in batch.column("window").take(pa.array(rows)).to_pylist()], dtype=np.int64)
                costs[lang][which[which >= 0]] = found[rows[which >= 0]]
        for lang, keys, many, numbers in self.blocks:
            cost = np.bincount(np.repeat(np.arange(len(keys)), many), costs[lang][numbers], len(keys))
            columns = [pa.array([lang] * len(keys), pa.string()), pa.array([k for k, _ in keys], pa.binary()), pa.array([n for _, n in keys], pa.int64()), pa.array(cost, pa.float64(), from_pandas=True), pa.array(many.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "key", "part", "cost", "symbols"])


def _priced(folder: str, order: int):
    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs and symbols of texts, or of their parts, by the table of costs in ``folder``."""
        held = _Held()
        for lang, block in _blocks(batches):
            held.add(lang, block, order)
            if held.full():
                yield from held.priced(folder)
                held = _Held()
        if held.blocks:
            yield from held.priced(folder)

    return priced


def _window_costs(windows: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``lang, window, cost``: of the last symbol of each distinct window; none where the language has no model.

    An n-gram that was seen has its shorter endings seen too, so those not seen are the ones backed off from.
    """
    base = grams.filter("gram = ''").select(F.col("lang").alias("_of"), (-F.log("p")).alias("base"))
    none = contexts.filter("context = ''").select(F.col("lang").alias("_on"), (-F.log("backoff")).alias("none"))
    base = settle(base.join(none, F.col("_of") == F.col("_on")).select("_of", (F.col("base") + F.col("none")).alias("base")), "kn-base")
    distinct = settle(windows.select("lang", "window").distinct(), "kn-distinct")
    n = F.length("window")
    parts = distinct.withColumn("s", F.explode(F.sequence(F.lit(1), n)))
    parts = parts.select("lang", "window", "s", F.substr("window", F.col("s")).alias("gram"), F.substr("window", F.col("s"), n - F.col("s")).alias("context"))
    seen = grams.filter("gram <> ''").select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), "p")
    met = settle(parts.join(seen, (F.col("lang") == F.col("_lang")) & (F.col("gram") == F.col("_gram")), "left").select("lang", "window", "s", "context", "p"), "kn-met")
    known = met.filter("p is not null").groupBy("lang", "window").agg((-F.log(F.min_by("p", "s"))).alias("cost"))
    weights = contexts.filter("context <> ''").select(F.col("lang").alias("_lang"), F.col("context").alias("_context"), "backoff")
    unseen = met.filter("p is null and context <> ''").join(weights, (F.col("lang") == F.col("_lang")) & (F.col("context") == F.col("_context")))
    unseen = unseen.select("lang", "window", (-F.log("backoff")).alias("cost"))
    # A symbol never seen.
    never = met.filter("p is null and context = ''").join(base, F.col("lang") == F.col("_of")).select("lang", "window", F.col("base").alias("cost"))
    return known.unionByName(unseen).unionByName(never).groupBy("lang", "window").agg(F.sum("cost").alias("cost"))


def _scores(docs: DataFrame, grams: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``lang, key, cost, symbols`` of every distinct text of a model; ``docs`` has ``lang`` (the model), ``key`` and ``text``."""
    if not 1 <= order <= 8:
        raise ValueError("windows are whole numbers of at most 8 symbols")
    windows = docs.mapInArrow(_distinct(order), "lang string, window string")
    folder = shared_uri(docs.sparkSession, "kn-costs")
    _window_costs(windows, grams, contexts).sortWithinPartitions("lang").write.parquet(folder)
    parts = docs.mapInArrow(_priced(folder, order), "lang string, key binary, part long, cost double, symbols long")
    # Copies of a text have the same parts.
    parts = parts.groupBy("lang", "key", "part").agg(F.min("cost").alias("cost"), F.min("symbols").alias("symbols"))
    return settle(parts.groupBy("lang", "key").agg(F.sum("cost").alias("cost"), F.sum("symbols").alias("symbols")), "kn-scores")


def _quantiles(held: DataFrame, quantile: float) -> DataFrame:
    """``_of, threshold``: the interpolated quantile of ``value`` by ``lang``, exact.

    Equal values are folded; buckets are counted, and only those in which the quantile lies are ranked.
    """
    folded = held.groupBy("lang", "value").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.log("value") * BUCKETS))
    folded = settle(folded, "kn-values")
    buckets = folded.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # As many rows as perplexities have buckets.
    buckets = buckets.withColumn("before", F.sum("n").over(W.partitionBy("lang").orderBy("bucket")) - F.col("n"))
    buckets = buckets.withColumn("at", F.lit(quantile) * (F.sum("n").over(W.partitionBy("lang")) - 1))
    low = F.floor("at")
    for_low, for_high = low, F.ceil("at")

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    wanted = buckets.filter(holds(for_low) | holds(for_high)).select(F.col("lang").alias("_of"), F.col("bucket").alias("_bucket"), F.col("before").alias("_start"), "at")
    near = folded.join(wanted, (F.col("lang") == F.col("_of")) & (F.col("bucket") == F.col("_bucket")))
    near = near.withColumn("before", F.col("_start") + F.sum("n").over(W.partitionBy("lang", "bucket").orderBy("value")) - F.col("n"))
    ends = near.groupBy("_of", "at").agg(F.max(F.when(holds(for_low), F.col("value"))).alias("lower"), F.max(F.when(holds(for_high), F.col("value"))).alias("upper"))
    return ends.select("_of", (F.col("lower") + (F.col("at") - low) * (F.col("upper") - F.col("lower"))).alias("threshold"))


def _judged(trusted: DataFrame) -> DataFrame:
    """``_judged``, stored: the languages that have a model and a quantile of their own."""
    parts = trusted.groupBy("lang").agg(F.count(F.when(F.col("fit"), 1)).alias("fit"), F.count(F.when(~F.col("fit"), 1)).alias("held"))
    return settle(parts.filter((F.col("fit") > 0) & (F.col("held") >= LEAST_CALIBRATION)).select(F.col("lang").alias("_judged")), "kn-judged")


def _modelled(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``rows`` with ``lang`` turned into the name of the model by which they are judged."""
    model = F.when(F.col("_judged").isNotNull(), F.concat(F.lit("="), F.col("_judged"))).otherwise(F.lit(POOL))
    return rows.join(judged, F.coalesce(F.col("lang"), F.lit("")) == F.col("_judged"), "left").withColumn("lang", model).drop("_judged")


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The judged languages, ``lang, key, cost, symbols`` of every distinct text by model, and ``_of, mean, threshold`` of the models.

    Where any document needs the model of all languages, that is fitted on all
    documents to fit on, and all that are held out are scored by it as well.
    """
    # Not stored: Spark then knows that ``fit`` is a function of the id, and shuffles no text that is not fitted on.
    good = _trusted_ids(labels)
    trusted = _trusted(docs, good)
    judged = _judged(trusted)
    texts = docs.select(_key(docs["lang"], docs["text"]).alias("key"), docs["lang"].alias("lang"), F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("text"))
    by_model = _modelled(texts, judged)
    pooled = not _modelled(docs.select(docs["lang"].alias("lang")), judged).filter(F.col("lang") == POOL).isEmpty()
    ids = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), _key(docs["lang"], docs["text"]).alias("key"))
    out = good.filter("not fit")
    held = ids.join(out, F.col("doc_id") == F.col("_id")).select("lang", "key")
    own = _modelled(held, judged).filter(F.col("lang") != POOL).select("lang", "key")
    to_fit, to_score, keys = _modelled(trusted, judged).filter((F.col("lang") != POOL) & F.col("fit")), by_model, own
    if pooled:
        told = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text")).join(out, F.col("doc_id") == F.col("_id"))
        to_fit = to_fit.unionByName(trusted.filter("fit").withColumn("lang", F.lit(POOL)))
        told = told.select(_key(F.col("lang"), F.col("text")).alias("key"), F.lit(POOL).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
        to_score = to_score.unionByName(told)
        keys = keys.unionByName(held.select(F.lit(POOL).alias("lang"), "key"))
    grams, contexts = kneser_ney(to_fit, order)
    scores = _scores(to_score, grams, contexts, order)
    keys = keys.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"))
    held = keys.join(scores, (F.col("_key") == F.col("key")) & (F.col("_lang") == F.col("lang"))).filter("cost is not null")
    held = settle(held.select("lang", "cost", "symbols"), "kn-calibration")
    means = held.groupBy("lang").agg((F.sum("cost") / F.nullif(F.sum("symbols"), F.lit(0))).alias("mean"))
    means = settle(means.filter(F.col("mean").isNotNull()).select(F.col("lang").alias("_in"), "mean"), "kn-means")
    values = held.join(means, F.col("lang") == F.col("_in")).select("lang", _smooth().alias("value"))
    limits = _quantiles(values, quantile).join(means, F.col("_of") == F.col("_in")).select("_of", "mean", "threshold")
    return judged, scores, settle(limits, "kn-limits")


def _smooth() -> Column:
    return F.exp((F.col("cost") + PRIOR * F.col("mean")) / (F.col("symbols") + PRIOR))


def _verdicts(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """``_model, _scored, perplexity, threshold`` of the texts scored."""
    told = scores.join(limits, F.col("lang") == F.col("_of"), "left")
    return told.select(F.col("lang").alias("_model"), F.col("key").alias("_scored"), _smooth().alias("perplexity"), "threshold")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, kept`` for every row.

    A document is rejected if its perplexity per symbol exceeds the quantile of
    the trusted documents of its language that the model was not fitted on; in a
    language with few of these, that of the trusted documents of all languages, by
    a model of them all. Null and blank texts have the mean and are kept. Rows that
    repeat are judged each; extra columns are ignored; an empty table gives an empty
    one. Where no trusted document with words is fitted on, or none held out, everything is kept.
    """
    judged, scores, limits = fit(docs, labels, quantile=quantile)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("_lang"), docs["lang"].alias("lang"), _key(docs["lang"], docs["text"]).alias("_key"))
    told = _modelled(rows, judged).join(_verdicts(scores, limits), (F.col("_key") == F.col("_scored")) & (F.col("lang") == F.col("_model")), "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return told.select("doc_id", F.col("_lang").alias("lang"), "perplexity", "threshold", kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without those rejected; all columns are kept."""
    judged, scores, limits = fit(docs, labels, quantile=quantile)
    bad = settle(_verdicts(scores, limits).filter("perplexity > threshold").select("_model", F.col("_scored").alias("_bad")), "kn-bad")
    row = docs.select(docs["lang"].alias("lang"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    told = _modelled(row, judged)
    return told.join(bad, (_key(F.col("_row.lang"), F.col("_row.text")) == F.col("_bad")) & (F.col("lang") == F.col("_model")), "left_anti").select("_row.*")


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
