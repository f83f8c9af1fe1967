"""Spelling variants: words one edit apart, found over a reduced alphabet, and the form that each variant leads to.

Letters are hashed to a few symbols. Two words one edit apart are at most one edit apart over any alphabet, so the full
one-edit neighbourhood of a reduced word (itself, every deletion, replacement and insertion of a symbol) holds the
reduced forms of all its near words. Neighbourhoods are made as arrays of rolling hashes; a bit table of fixed size
lets only those travel that may be in the reduced vocabulary. Reduced words that meet are opened into their words.
Near words keep their first or last half, so they meet at a half of the original, not as all pairs of two reduced
words, and are verified on the original strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.blocks import mix
from palimpsest.session import durable

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS = 5
MIN_COUNT = 3
SYMBOLS = 8
DOMINANCE = 2  # a form occurs at least so many times as often as its variant
TASK_WORDS = 500_000  # different words a task counts before it sends them on
CELLS = 1 << 18  # letters whose neighbourhoods are made at once; a longer word stands alone
FILTER_BITS = 1 << 26  # of the reduced vocabulary's bit table, a fixed size
BITMAP_BITS = 32_768  # of one bitmap of Spark's bitmap_construct_agg
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int = 0, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of Latin letters of whole texts, A-Z lower-cased, that hold `min_chars` and occur `min_count` times.

    `drop_every` > 0 plants errors: with h the CRC-32 of `<doc_id>:<run>`, a run loses its code point h % length where
    `drop_every` divides h (a null doc_id is written as nothing). Null texts have no words. Repeated rows count again;
    other columns are not looked at.
    """
    plain = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))

    def sent(counts: Counter) -> pa.RecordBatch:
        words = [w for w, n in counts.items() if n and len(w) >= min_chars]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        crc32 = zlib.crc32
        for batch in batches:
            for own, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = RUN.findall((value.as_py() or "").encode().lower().decode())  # of bytes, only A-Z change
                counts.update(found)
                begun = crc32(f"{own}:".encode())
                for word in set(found) if drop_every else ():
                    h = crc32(word.encode(), begun)
                    if h % drop_every == 0:
                        at, times = h % len(word), found.count(word)
                        counts[word] -= times
                        counts[word[:at] + word[at + 1 :]] += times
                if len(counts) >= TASK_WORDS:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    counted = plain.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words of one length, their symbols as numbers from 1, a row each)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    symbol = (mix(points + np.uint64(1)) % np.uint64(symbols)) + np.uint64(1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, CELLS // max(1, length))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            yield some, symbol[starts[some][:, None] + np.arange(length)]


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _finished(hashes: np.ndarray, length: int) -> np.ndarray:
    """Keys of reduced words from their rolling hashes and their length."""
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64(length) * _LENGTH)


def neighbourhood(symbols: np.ndarray, alphabet: int) -> Iterator[tuple[np.ndarray, int]]:
    """(keys of some neighbours, their length): the words themselves, all deletions, replacements and insertions."""
    length = symbols.shape[1]
    powers = _powers(length + 1)
    terms = symbols * powers[:length]
    before = np.zeros((len(symbols), length + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:], dtype=np.uint64)
    whole = before[:, -1:]
    yield _finished(whole, length), length
    if length:
        yield _finished(before[:, :-1] + (whole - before[:, 1:]) * _INVERSE, length - 1), length - 1
    moved = before + (whole - before) * np.uint64(_BASE)
    for symbol in range(1, alphabet + 1):
        if length:
            yield _finished(whole - terms + np.uint64(symbol) * powers[:length], length), length
        yield _finished(moved + np.uint64(symbol) * powers, length + 1), length + 1


def _keyed(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """word, n and key of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            keys = np.empty(len(words), dtype=np.uint64)
            for places, found in _reduced(words, symbols):
                keys[places] = next(neighbourhood(found, 0))[0][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


def _bit_table(keys: DataFrame):
    """The low bits of all keys as a broadcast table of FILTER_BITS bits."""
    place = F.col("key").bitwiseAND(FILTER_BITS - 1)
    maps = keys.groupBy(F.expr(f"({FILTER_BITS - 1} & key) div {BITMAP_BITS}").alias("part")).agg(F.bitmap_construct_agg(place % BITMAP_BITS).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        bits = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        table[row["part"] * (BITMAP_BITS // 8) :][: len(bits)] = bits
    return keys.sparkSession.sparkContext.broadcast(table)


def _links(reduced: DataFrame, bits, symbols: int) -> DataFrame:
    """r, v, m: reduced words that may be neighbours, the smaller key first, and the length of the shorter one.

    `reduced` has a row per reduced word: key, one of its words, and how many it has. Of both directions one is kept;
    a reduced word meets itself if it has several words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            several = batch.column("words").to_numpy() > 1
            for places, found in _reduced(batch.column("word").to_pylist(), symbols):
                own, near, least = next(neighbourhood(found, 0))[0][:, 0], [], []
                rows = []
                for keys, length in neighbourhood(found, symbols):
                    low = keys & np.uint64(FILTER_BITS - 1)
                    there = (table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    there &= keys.view(np.int64) >= own.view(np.int64)[:, None]
                    row, column = np.nonzero(there)
                    rows.append(row)
                    near.append(keys[row, column])
                    least.append(np.full(len(row), min(length, found.shape[1]), dtype=np.int32))
                row, v, m = map(np.concatenate, (rows, near, least))
                kept = (v != own[row]) | several[places[row]]
                row, v, m = row[kept], v[kept], m[kept]
                order = np.lexsort((v, row))
                row, v, m = row[order], v[order], m[order]
                first = np.ones(len(row), dtype=bool)
                first[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(own[row[first]].view(np.int64)), pa.array(v[first].view(np.int64)), pa.array(m[first])], ["r", "v", "m"])

    return reduced.select("key", "word", "words").mapInArrow(run, "r bigint, v bigint, m int")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, n_a, b, n_b: each pair of words of `vocabulary` (word, n; each word once) that differ by one inserted, deleted or
    replaced code point. A pair is one row. Null words are near to nothing."""
    keyed = durable(_keyed(vocabulary.where("word is not null"), symbols))
    reduced = durable(keyed.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("words")))
    known = reduced.select("key")
    links = _links(reduced, _bit_table(known), symbols).join(known.withColumnRenamed("key", "v"), "v", "left_semi")
    links = durable(links)
    half = F.expr("m div 2")

    def opened(side: str, word: str, n: str) -> DataFrame:
        rows = links.join(keyed.select(F.col("key").alias(side), F.col("word").alias(word), F.col("n").alias(n)), side)
        halves = F.array(F.struct(F.lit(0).alias("part"), F.left(word, half).alias("half")), F.struct(F.lit(1).alias("part"), F.right(word, half).alias("half")))
        return rows.select("r", "v", word, n, F.explode(halves).alias("h")).select("r", "v", word, n, "h.part", "h.half")

    met = opened("r", "a", "n_a").join(opened("v", "b", "n_b"), ["r", "v", "part", "half"])
    apart = met.where("r <> v or a < b").where(F.levenshtein("a", "b", 1) == 1)
    return apart.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form reached from each row of `forms` (word, form); forms must not lead in a circle.

    Pointers double their reach each round, and counts at least double along forms, so six rounds reach any end.
    """
    current = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not current.where("moved").isEmpty():
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current = durable(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return current.select("word", "root")


def group_variants(vocabulary: DataFrame, dominance: int = DOMINANCE, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of `vocabulary` (word, n; each word once).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least `dominance`
    (2 or more, so that forms cannot lead in a circle) times the word's own; its root is the last word reached by forms,
    itself if it has none. An empty vocabulary gives no rows.
    """
    vocabulary = durable(vocabulary.select("word", "n"))
    pairs = durable(near_words(vocabulary, symbols))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    leads = -F.col("best.less") >= dominance * F.col("n")
    formed = durable(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
