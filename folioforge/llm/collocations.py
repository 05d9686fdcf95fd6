"""Phrase collocation mining: frequent words as numbers, n-grams as fixed-width keys, sorted by digits and counted by runs.

A first pass counts words by language. Words that occur often enough get numbers, the most frequent of all
languages first, up to DICTIONARY words of at most WORD_BYTES, so the dictionary that goes to every worker
has a bound in bytes. A second pass replaces words by numbers; a rare word is a break, as no phrase with it
can be frequent. An n-gram of up to three numbers of 21 bits is one key of 63 bits. A task sorts its keys by
digits of 16 bits (numpy's stable sort of 16-bit numbers is a radix sort), counts runs, and sends for each
key range one binary row of distinct keys and their counts. Ranges are cut beforehand, monotone in the key:
where a key falls is what the counts of its words say if words were independent, so a frequent first word has
many ranges and no range more than about RANGE_KEYS keys. Ranges are shuffled, each is sorted and run-length
summed again in one place, and what is left are the frequent n-grams.

The rest, exactly: frequent words beyond the dictionary are marked in a bitmap of bounded size; n-grams with
a word that may be one of them are counted by their strings in a further pass, which is made only where such
words exist. What passes the bitmap by chance is rare and goes with its count.

Scores, cuts and containment are joins of the frequent n-grams with each other; the first rows of a language
are taken within parts first, so that no task sorts a whole language.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.shipping import ship

from .common import bitmap, held, in_bitmap, materialise, parallelism, rows, settle, tables_now, tidied, unpack

DICTIONARY, WORD_BYTES = (1 << 19) - 1, 64
#: Keys of a range, about, and keys that a task sorts at once.
RANGE_KEYS, FOLD_KEYS = 1 << 22, 1 << 21
#: Parts of a language whose first rows are taken apart: what meets at the end has a bound of so many times the rows wanted.
TOP_PARTS = 64
#: Distinct words that a task counts before it sends them on; bytes of a text that are words at once.
FOLD_WORDS, WINDOW_BYTES = 200_000, 1 << 20

_BITS = 21
_BREAK = b"\xff"
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")

_COUNTED = "lang string, word binary, f bigint"
_RANGES = "range bigint, keys binary, counts binary"
_FREQUENT = "lang string, w1 string, w2 string, w3 string, a bigint, c1 bigint, c2 bigint, c3 bigint"
_STRINGS = "lang string, w1 binary, w2 binary, w3 binary, a bigint"


def words_of(text: bytes, window: int = WINDOW_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, lower-cased, with the token BREAK wherever a piece ends; a list for each window of the text."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + window)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().translate(_PIECES).replace(_BREAK, b" \xff ").split()
        at = end


def radix_sorted(keys: np.ndarray) -> np.ndarray:
    """Least significant digit first, 16 bits at a time; digits that all keys share are left out."""
    if len(keys) < 2:
        return keys
    differ = int(np.bitwise_or.reduce(keys ^ keys[0]))
    for shift in range(0, 64, 16):
        if differ >> shift & 0xFFFF:
            keys = keys[np.argsort((keys >> shift).astype(np.uint16), kind="stable")]
    return keys


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and where each run starts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], starts


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.arange(len(keys))
    if len(keys) > 1:
        differ = int(np.bitwise_or.reduce(keys ^ keys[0]))
        for shift in range(0, 64, 16):
            if differ >> shift & 0xFFFF:
                order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
    distinct, starts = runs(keys[order])
    return distinct, np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


class Dictionary:
    """Numbers of frequent words by language: from 1, a language's words together, the most frequent first."""

    def __init__(self, langs: list[str], words: list[bytes], counts: list[int]):
        order = sorted(range(len(words)), key=lambda k: (langs[k], -counts[k], words[k]))
        self.langs, self.words = [langs[k] for k in order], [words[k] for k in order]
        self.counts = np.array([0, *(counts[k] for k in order)], np.int64)
        self.number: dict[str, dict[bytes, int]] = {}
        first = np.zeros(len(words) + 1, np.int64)
        for k, (lang, word) in enumerate(zip(self.langs, self.words), 1):
            of = self.number.setdefault(lang, {})
            first[k] = k - len(of)
            of[word] = k
        # For each number: the share of all words up to it, and its own; the same within its language.
        total, sums = max(1, int(self.counts.sum())), np.cumsum(self.counts)
        before = np.concatenate([[0], sums[:-1]])
        last = np.searchsorted(first, first, side="right") - 1
        own = np.maximum(1, sums[last] - before[first])
        self.place, self.share = before / total, self.counts / total
        self.inner, self.part = (before - before[first]) / own, self.counts / own
        self.inner[0] = self.part[0] = 0

    def packed(self) -> bytes:
        """For a broadcast."""
        tell = [struct.pack("<qHH", int(c), len(lang), len(word)) + lang + word for c, lang, word in zip(self.counts[1:], (x.encode() for x in self.langs), self.words)]
        return b"".join(tell)

    @classmethod
    def unpacked(cls, data: bytes) -> Dictionary:
        langs, words, counts, at = [], [], [], 0
        while at < len(data):
            c, n, m = struct.unpack_from("<qHH", data, at)
            at += 12
            langs.append(data[at : at + n].decode())
            words.append(data[at + n : at + n + m])
            counts.append(c)
            at += n + m
        return cls(langs, words, counts)

    def ranges(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Which of n ranges each key lies in: never falls as keys rise."""
        a, b, c = keys >> 2 * _BITS, keys >> _BITS & ((1 << _BITS) - 1), keys & ((1 << _BITS) - 1)
        at = self.place[a] + self.share[a] * (self.inner[b] + self.part[b] * self.inner[c])
        return np.minimum(n - 1, (at * n).astype(np.int64))


def _count_words(fold_words: int, window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, word, f) summed within the task; a null word has the number of all words."""
        found: dict[str, Counter] = {}
        total: Counter = Counter()
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                listed = list(words)
                for at in range(0, len(listed), 20_000):
                    part = listed[at : at + 20_000]
                    arrays = [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([words[w] for w in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "f"])
            found.clear()

        for langs, texts in rows(batches):
            for lang, text in zip(langs, texts):
                of = found.setdefault(lang, Counter())
                for words in words_of(text, window):
                    size -= len(of)
                    of.update(words)
                    size += len(of)
                    total[lang] += len(words) - of.pop(_BREAK, 0)
                    if size > fold_words:
                        yield from sent()
                        size, of = 0, found.setdefault(lang, Counter())
        yield from sent()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "f"])

    return count


class Grams:
    """Sequences of numbers, 0 for breaks, in folds: fold() has the n-grams that add() completed."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.carried = 0

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(numbers)
        self.size += len(numbers)

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, starts of pairs, starts of triples); the last two numbers are kept for what follows."""
        seq = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        there = seq != 0
        two = there[:-1] & there[1:]
        three = two[:-1] & there[2:]
        pairs, triples = np.flatnonzero(two), np.flatnonzero(three)
        if self.carried == 2:
            pairs = pairs[pairs > 0]  # the pair of the two numbers carried was counted before
        self.parts, self.carried = [seq[-2:]], min(2, len(seq))
        self.size = self.carried
        return seq, pairs, triples


_BETWEEN = np.zeros(1, np.int64)


def _count_keys(dictionary, n_ranges: int, fold_keys: int, window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held("collocations", lambda: Dictionary.unpacked(dictionary.value))
        grams = Grams()

        def sent() -> pa.RecordBatch:
            seq, pairs, triples = grams.fold()
            high = seq << 2 * _BITS
            middle = seq << _BITS
            keys = np.concatenate([high[pairs] | middle[pairs + 1], high[triples] | middle[triples + 1] | seq[triples + 2]])
            keys, starts = runs(radix_sorted(keys))
            return keys, np.diff(np.append(starts, len(pairs) + len(triples))).astype(np.uint32)

        def batch() -> Iterator[pa.RecordBatch]:
            keys, counts = sent()
            at = d.ranges(keys, n_ranges)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(keys)) if len(keys) else np.zeros(1, np.int64)
            for first in range(0, len(cuts) - 1, 1024):
                edges = cuts[first : first + 1025].tolist()
                spans = list(zip(edges[:-1], edges[1:]))
                cells = [[int(at[a]) for a, _ in spans], [planes(keys[a:b]) for a, b in spans], [planes(counts[a:b]) for a, b in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.binary(), pa.binary()))], ["range", "keys", "counts"])

        for langs, texts in rows(batches):
            for lang, text in zip(langs, texts):
                number = d.number.get(lang)
                if number is None:
                    continue
                for words in words_of(text, window):
                    grams.add(np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words)))
                    if grams.size >= fold_keys // 2:
                        yield from batch()
                grams.add(_BETWEEN)
        yield from batch()

    return count


def planes(numbers: np.ndarray) -> bytes:
    """Fixed-width binary, byte plane by byte plane, highest first: the high bytes of sorted keys repeat, and compress."""
    width = numbers.dtype.itemsize
    return numbers.astype(numbers.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().reshape(-1).view(np.dtype(kind).newbyteorder(">")).astype(kind)


def _frequent_keys(dictionary, least: int, fold_keys: int):
    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range: each range's keys are sorted and their counts summed; the frequent ones leave as words."""
        d = held("collocations", lambda: Dictionary.unpacked(dictionary.value))
        now, keys, counts, size, most = None, [], [], 0, 2 * fold_keys

        def folded() -> tuple[np.ndarray, np.ndarray]:
            return merged(np.concatenate(keys), np.concatenate(counts))

        def sent() -> Iterator[pa.RecordBatch]:
            k, n = folded()
            k, n = k[n >= least], n[n >= least]
            for at in range(0, len(k), 20_000):
                part, mask = k[at : at + 20_000], (1 << _BITS) - 1
                ids = [(part >> 2 * _BITS).tolist(), (part >> _BITS & mask).tolist(), (part & mask).tolist()]
                words = [[d.words[i - 1].decode() if i else None for i in column] for column in ids]
                langs = [d.langs[i - 1] for i in ids[0]]
                c = [[int(d.counts[i]) if i else None for i in column] for column in ids]
                arrays = [pa.array(langs, pa.string()), *[pa.array(w, pa.string()) for w in words], pa.array(n[at : at + 20_000], pa.int64()), *[pa.array(x, pa.int64()) for x in c]]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _FREQUENT.split(", ")])

        for batch in batches:
            for r, k, n in zip(*(c.to_pylist() for c in batch.columns)):
                if r != now:
                    if keys:
                        yield from sent()
                    now, keys, counts, size, most = r, [], [], 0, 2 * fold_keys
                keys.append(from_planes(k, "i8"))
                counts.append(from_planes(n, "u4").astype(np.int64))
                size += len(keys[-1])
                if size > most:  # distinct keys are what a range holds, however often they come
                    k, n = folded()
                    keys, counts, size = [k], [n], len(k)
                    most = 2 * max(fold_keys, size)
        if keys:
            yield from sent()

    return sum_up


def _count_strings(dictionary, marked: bytes, fold_words: int, window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-grams with a word that may be frequent and is not in the dictionary, by their strings."""
        d = held("collocations", lambda: Dictionary.unpacked(dictionary.value))
        bits = unpack(marked)
        found: Counter = Counter()

        def numbers(lang: str, words: list[bytes], beyond: list[bytes]) -> np.ndarray:
            known = d.number.get(lang, {})
            out = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
            unknown = [k for k in np.flatnonzero(out == 0).tolist() if words[k] != _BREAK]
            if unknown:
                hashes = [xxhash.xxh64_intdigest(lang.encode() + b"\0" + words[k], seed=42) for k in unknown]
                hit = in_bitmap(bits, pa.array(np.array(hashes, np.uint64).view(np.int64)))
                for k in np.array(unknown)[hit].tolist():
                    beyond.append(words[k])
                    out[k] = -len(beyond)
            return out

        def fold(lang: str, grams: Grams, beyond: list[bytes]) -> None:
            seq, pairs, triples = grams.fold()
            word = lambda i: d.words[i - 1] if i > 0 else beyond[-i - 1]
            for starts, n in ((pairs, 2), (triples, 3)):
                here = np.stack([seq[starts + j] for j in range(n)], axis=1)
                found.update((lang, *map(word, g)) for g in here[(here < 0).any(axis=1)].tolist())

        def sent() -> Iterator[pa.RecordBatch]:
            listed = list(found.items())
            for at in range(0, len(listed), 20_000):
                part = listed[at : at + 20_000]
                words = [[g[j] if j < len(g) else None for g, _ in part] for j in range(1, 4)]
                arrays = [pa.array([g[0] for g, _ in part], pa.string()), *[pa.array(w, pa.binary()) for w in words], pa.array([c for _, c in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "w1", "w2", "w3", "a"])
            found.clear()

        for langs, texts in rows(batches):
            for lang, text in zip(langs, texts):
                grams, beyond = Grams(), []
                for words in words_of(text, window):
                    grams.add(numbers(lang, words, beyond))
                    fold(lang, grams, beyond)
                    if len(found) > fold_words:
                        yield from sent()
        yield from sent()

    return count


def _bounded(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words that fit the dictionary: all with at least the count that leaves no more than most of them."""
    fits = words.where(F.length("word") <= WORD_BYTES).where(F.length("lang") <= WORD_BYTES)
    step = F.floor(F.log2("f") * 16)
    levels = sorted(((r["step"], r["n"]) for r in fits.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # some hundreds
    least, taken = None, 0
    for level, n in levels:
        if taken + n > most:
            break
        least, taken = level, taken + n
    return fits.where(step >= least) if least is not None else fits.where("false")


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, dictionary_words: int, range_keys: int, fold_keys: int, window: int) -> DataFrame:
    """(lang, w1, w2, w3, a, c1, c2, c3): phrases of two words (w3 null) and three that occur least times, and how often their words do."""
    spark = docs.sparkSession
    chosen = _bounded(words, dictionary_words)
    listed = chosen.select("lang", "word", "f").toArrow()
    known = Dictionary(*(listed.column(c).to_pylist() for c in ("lang", "word", "f")))
    told = spark.sparkContext.broadcast(known.packed())
    occurrences = 2 * int(known.counts.sum())
    n = parallelism(spark)
    n_ranges = max(4 * n, occurrences // range_keys)
    texts = docs.select("lang", "text")
    sent = texts.mapInArrow(tidied(_count_keys(told, n_ranges, fold_keys, window), "collocations"), _RANGES)
    met = sent.repartition(max(n, n_ranges // 4), "range").sortWithinPartitions("range")
    found = materialise(met.mapInArrow(tidied(_frequent_keys(told, least, fold_keys), "collocations"), _FREQUENT), "phrases")
    rest = words.join(chosen.select("lang", "word"), ["lang", "word"], "left_anti") if listed.num_rows < words.count() else None
    if rest is None:
        return found
    name = F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word"))
    marked = bitmap(rest.select(F.xxhash64(name).alias("k")), "k")
    strings = texts.mapInArrow(tidied(_count_strings(told, marked, FOLD_WORDS, window), "collocations"), _STRINGS)
    more = strings.groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    for k in (1, 2, 3):
        more = more.join(words.select("lang", F.col("word").alias(f"w{k}"), F.col("f").alias(f"c{k}")), ["lang", f"w{k}"], "left")
    string = lambda c: F.decode(F.col(c), "UTF-8").alias(c)
    more = materialise(more.select("lang", string("w1"), string("w2"), string("w3"), "a", "c1", "c2", "c3"), "morephrases")
    return found.unionByName(more)


def _floor_score(a: str, first: str, rest: str) -> F.Column:
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)).cast("decimal(30,0)"), whole(first) * whole(rest)).cast("long")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 10,
    top: int = 2000,
    covered_percent: int = 50,
    dictionary_words: int = DICTIONARY,
    range_keys: int = RANGE_KEYS,
    fold_keys: int = FOLD_KEYS,
    window_bytes: int = WINDOW_BYTES,
) -> DataFrame:
    """The first rows of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and the line breaks 0A to 0D, and pieces into
    words at spaces and tabs. Null texts are empty, a null language is und, like a language of that name; a
    repeated row counts again. A phrase of two or three words with a >= least occurrences is scored by the
    weakest of its cuts, floor(1000000 a a / (l r)), the first of equal ones; it is dropped if a longer phrase
    that holds it occurs in at least covered_percent of its occurrences. Order: score, a, both falling, then the
    phrase by its bytes. A table without texts gives an empty result. Other columns are not read. Counts may reach
    10^15; products are decimals of 38 digits.
    """
    spark = docs.sparkSession
    ship(spark)
    before = tables_now()
    told = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    counted = told.mapInArrow(tidied(_count_words(FOLD_WORDS, window_bytes)), _COUNTED)
    counted = counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = materialise(counted.where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    words = counted.where("word is not null")
    found = frequent_phrases(told, words, least, dictionary_words, range_keys, fold_keys, window_bytes)

    two, three = found.where("w3 is null").drop("w3", "c3"), found.where("w3 is not null")
    pair = two.select("lang", "w1", "w2", F.col("a").alias("f"))
    with_first = three.join(pair.withColumnRenamed("f", "f12"), ["lang", "w1", "w2"])
    with_both = with_first.join(pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["lang", "w2", "w3"])
    cuts = with_both.withColumns({"s1": _floor_score("a", "c1", "f23"), "s2": _floor_score("a", "f12", "c3")})
    first = F.col("s1") <= F.col("s2")
    phrase = lambda *c: F.concat_ws(" ", *c).alias("phrase")
    triples = cuts.select(
        "lang",
        phrase("w1", "w2", "w3"),
        "a",
        F.when(first, F.col("c1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("c3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    longer = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    apart = two.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("a") * covered_percent)
    pairs = apart.select("lang", phrase("w1", "w2"), "a", F.col("c1").alias("l"), F.col("c2").alias("r"), _floor_score("a", "c1", "c2").alias("score"))

    best = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    scored = pairs.unionByName(triples).withColumn("part", part)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = scored.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = counted.where("word is null").select("lang", F.col("f").alias("n"))
    out = materialise(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    settle(before, out)
    return out


#: The same result in SQL.
COLLOCATIONS_SQL = r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
    g AS (
        SELECT w.lang, k.k AS size, unnest(list_transform(range(1, len(ws) - k.k + 2), lambda i: array_to_string(ws[i:i + k.k - 1], ' '))) AS phrase
        FROM w, (VALUES (1), (2), (3)) AS k(k)),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 10),
    cuts AS (
        SELECT c.*, k.k, array_to_string(ws[1:k.k], ' ') AS head, array_to_string(ws[k.k + 1:], ' ') AS tail
        FROM c, (VALUES (1), (2)) AS k(k) WHERE k.k < c.size),
    s AS (
        SELECT cuts.lang, cuts.size, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r,
               ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.size = k AND x.phrase = head
                  JOIN f AS y ON y.lang = cuts.lang AND y.size = cuts.size - k AND y.phrase = tail),
    one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1),
    inner_pairs AS (
        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE size = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE size = 3),
    longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_pairs GROUP BY ALL),
    kept AS (
        SELECT one.* FROM one LEFT JOIN longest AS m ON m.lang = one.lang AND m.phrase = one.phrase AND one.size = 2
        WHERE 100 * coalesce(m.longer, 0) < 50 * one.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""
