"""Benchmark decontamination: prefix-filtered containment join of item windows and documents.

Every window of an item (WINDOW consecutive words, or the whole of a shorter item) is a set of
shingles that a document must hold in full. For full containment one shingle is a sufficient prefix,
so each window joins by its rarest shingle alone, rarity being counted over all documents. The place
of that shingle inside the window gives the only place where the window can start (positional
bound); windows that would leave the document are dropped (length bound); the words themselves are
then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from palimpsest.llm.blocks import LETTERS, Words, slices
from palimpsest.session import durable

WINDOW = 10  # words
SHINGLE = 4  # words; items with fewer words use all of them
FILTER_BITS = 1 << 23  # size of the filter sent to tasks, whatever the benchmark's size


def _filter(spark: SparkSession, tokens: DataFrame):
    """A broadcast table with a bit for the place of each token; its size does not depend on their number."""
    bits = np.zeros(FILTER_BITS, dtype=bool)
    places = tokens.select(F.expr(f"cast(token & {FILTER_BITS - 1} as int)").alias("b")).distinct()
    for row in places.groupBy((F.col("b") / 4096).cast("int")).agg(F.collect_list("b").alias("b")).toLocalIterator():
        bits[row["b"]] = True
    return spark.sparkContext.broadcast(np.packbits(bits))


def _candidates(words: Words, bits: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size: the words at which a shingle starts that may be a token, and its hash."""
    for k in sizes:
        hashes, room = words.windows(k)
        at = np.flatnonzero(room & bits[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
        yield k, at, hashes[at].view(np.int64)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per window of `items` and shingle in it: item, m (words), k (words of the shingle), window
    (its words), token (hash of the shingle) and place (of the shingle in the window). Items without
    words (null and empty texts) have none; equal windows of an item are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            for first, texts in slices(batch.column("text")):
                words = Words(texts, LETTERS)
                shingles = {k: words.windows(k)[0].view(np.int64) for k in range(1, SHINGLE + 1)}
                out: dict[str, list] = {"item": [], "m": [], "k": [], "window": [], "token": [], "place": []}
                for row in range(len(texts)):
                    begin, end = words.bounds[row], words.bounds[row + 1]
                    m = int(min(WINDOW, end - begin))
                    k = min(SHINGLE, m)
                    for start in range(begin, end - m + 1) if m else ():
                        window = words.texts(start, start + m)
                        for place in range(m - k + 1):
                            for name, value in zip(out, (ids[first + row], m, k, window, int(shingles[k][start + place]), place)):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.string()), ("m", pa.int32()), ("k", pa.int32()), ("window", pa.string()), ("token", pa.int64()), ("place", pa.int32())]))

    plain = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "item string, m int, k int, window string, token bigint, place int").distinct()


def token_counts(documents: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each token occurs in all documents: token, occurrences."""
    table = _filter(documents.sparkSession, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value).view(bool)
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                for _, _, hashes in _candidates(Words(texts, LETTERS), bits, sizes):
                    values, counts = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["token", "n"])

    counted = documents.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("occurrences"))
    return counted.join(tokens.select("token").distinct(), "token", "left_semi")


def document_hits(documents: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per document: row (its number), doc_id, text_hash, n_words, and hits: token, place, base (first word of the
    context) and context (the words around, as far as a window may reach)."""
    table = _filter(documents.sparkSession, tokens)
    hit = pa.struct([("token", pa.int64()), ("place", pa.int64()), ("base", pa.int64()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value).view(bool)
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                words = Words(texts, LETTERS)
                lists: list[list] = [[] for _ in range(len(texts))]
                for k, at, hashes in _candidates(words, bits, sizes):
                    rows = np.searchsorted(words.bounds, at, "right") - 1
                    for place, token, row in zip(at.tolist(), hashes.tolist(), rows.tolist()):
                        begin, end = int(words.bounds[row]), int(words.bounds[row + 1])
                        base = max(begin, place - WINDOW + k)
                        lists[row].append((token, place - begin, base - begin, words.texts(base, min(end, place + WINDOW))))
                names = ("token", "place", "base", "context")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), batch.column("text_hash").slice(first, len(texts)), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array([[dict(zip(names, x)) for x in xs] for xs in lists], type=pa.list_(hit))],
                    ["doc_id", "text_hash", "n_words", "hits"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_words bigint, hits array<struct<token: bigint, place: bigint, base: bigint, context: string>>").select(
        F.monotonically_increasing_id().alias("row"), "*"
    )


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window of an item), items (ids of
    the items with occurring windows, as sorted distinct texts).

    A null text has no words; neither such documents nor items without words hit anything. Every row of
    `documents` gives one row, also when ids repeat or are null; items with a null id count like
    others and are listed as the text 'null'. Other columns are not looked at.
    """
    spark = documents.sparkSession
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).alias("text"))
    windows = durable(item_windows(named))
    sizes = [row["k"] for row in windows.select("k").distinct().orderBy("k").collect()]
    rarity = token_counts(plain.select("text"), windows, sizes)
    order = Window.partitionBy("item", "window").orderBy("occurrences", "token", "place")
    prefix = (
        windows.join(rarity, "token")  # a window with a shingle that occurs nowhere occurs nowhere
        .withColumn("shingles", F.count("*").over(Window.partitionBy("item", "window")))
        .where("shingles = m - k + 1")
        .withColumn("rank", F.row_number().over(order))
        .where("rank = 1")
        .select("item", "m", "window", "token", F.col("place").cast("bigint").alias("inside"))
    )
    prefix = durable(prefix)
    documents_ = durable(document_hits(plain, prefix, sizes))
    hits = documents_.where(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    begin = F.col("place") - F.col("inside")
    words = F.slice(F.split("context", " "), (begin - F.col("base") + 1).cast("int"), F.col("m"))
    occurring = (
        hits.join(prefix, "token")
        .where((begin >= F.col("base")) & (begin + F.col("m") <= F.col("n_words")))
        .where(F.array_join(words, " ") == F.col("window"))
        .select("row", "item", begin.alias("begin"), (begin + F.col("m")).alias("end"))
    )
    occurring = durable(occurring)
    spans = occurring.groupBy("row", "begin").agg(F.max("end").alias("end"))
    reached = F.max("end").over(Window.partitionBy("row").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(reached, F.lit(0)))).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    named_items = occurring.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        documents_.select("row", "doc_id", "text_hash", "n_words")
        .join(covered.join(named_items, "row"), "row", "left")
        .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
