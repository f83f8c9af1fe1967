"""Token ids in Parquet list columns, with chosen encodings, row groups and page indexes.

Ids are dictionary encoded (a vocabulary fits into one dictionary page), counts and document ids delta
encoded. Page indexes let a reader skip to the pages of a few documents; columns that are not asked
for are not read, so counts and positions come without any token bytes. Spark's writer commits the files,
so retried tasks leave nothing behind.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
CACHE_WORDS = 500_000
CACHE_WORD_BYTES = 64  # longer words are not remembered
BATCH_WORDS = 2_000
PIECE_BYTES = 8 << 20  # of text encoded at a time
FILE_BYTES = 64 << 20  # of text per file, about
SENT_IDS = 128  # of a document in a row on their way to a checksum

#: Writer options of the files.
OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}

#: A word of plain letters and the marks behind it. Its letters are composed already and have one lower-case form each.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
LETTERS, MARKS = ("".join(c for c in map(chr, range(0x21, 0x100)) if PLAIN.fullmatch(x.format(c))) for x in ("{}", "a{}"))
MARKS = MARKS.translate(dict.fromkeys(map(ord, LETTERS)))
PROBES = ("the", "Straße", "ÉTÉ", "ÿÀé", "xqzjv", "don")


class WordEncoder:
    """Ids of words by a tokenizers file.

    Where words are lower-cased and runs of letters and of marks are split from each other, a word of plain letters
    is one input of the model, which then is asked without the steps before it. Probes decide whether that holds.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.table = self.tokenizer.model, {}
        split = self.tokenizer.pre_tokenizer
        if split is not None:
            self.table = {ord(c): "".join(x for x, _ in split.pre_tokenize_str(c)) for c in map(chr, range(0xC0, 0x100)) if c not in "×÷"}
        tails = ((w, m) for w in PROBES for m in ("", ".", "'", "_'!"))
        self.simple = all(self.batch([w + m])[0] == self.plain(w.lower()) + (self.batch([m])[0] if m else []) for w, m in tails)

    def plain(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.translate(self.table))]

    def batch(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class WordIds:
    """Ids of whole texts from the ids of their words.

    Right for tokenizers that never join text across a space or newline and drop both: then a text's ids
    are those of its words in a row. The texts of a batch are split as arrays, and a plain word into its lower-cased letters
    and its marks. These parts are encoded by the library once and remembered in arrays, up to a bound; those not met for
    the longest time go first.
    """

    def __init__(self, encoder: WordEncoder) -> None:
        self.encoder = encoder
        self.parts, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        self.met, self.now = np.zeros(0, dtype=np.int64), 0

    def of(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and `end_id`; a null text is empty."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        ends, coded = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py(), lists.flatten().dictionary_encode()
        del lists
        ids = pa.concat_arrays([self._words(coded.dictionary), pa.array([[end_id]], self.ids.type)])
        taken = ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(ids) - 1)))
        return pa.ListArray.from_arrays(taken.offsets.take(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]))), taken.values)

    def _words(self, words: pa.Array) -> pa.ListArray:
        """The ids of different words: of the letters and of the marks of plain ones, else of all and of nothing."""
        plain = pc.match_substring_regex(words, f"^{PLAIN.pattern}$") if self.encoder.simple else pa.array(np.zeros(len(words), dtype=bool))
        fronts = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, characters=MARKS)), words)
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=LETTERS), "")
        coded = pa.concat_arrays([fronts, tails]).dictionary_encode()
        ids, places = self._known(coded.dictionary)
        both = ids.take(pa.array(places[coded.indices.to_numpy()].reshape(2, -1).T.ravel()))
        return pa.ListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)

    def _known(self, parts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Lists of ids, and the place among them of each of some different parts."""
        places = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.now += 1
        self.met[places[places >= 0]] = self.now
        open_ = np.flatnonzero(places < 0)
        if not len(open_):
            return self.ids, places
        new = parts.take(pa.array(open_))
        learnt = pa.concat_arrays([pa.array(self._learn(new.slice(i, BATCH_WORDS).to_pylist()), self.ids.type) for i in range(0, len(new), BATCH_WORDS)])
        places[open_] = len(self.ids) + np.arange(len(open_))
        ids = pa.concat_arrays([self.ids, learnt])
        self.met = np.concatenate([self.met, np.where(pc.binary_length(new).to_numpy() <= CACHE_WORD_BYTES, self.now, 0)])
        self.parts, self.ids = pa.concat_arrays([self.parts, new]), ids
        if len(self.met) > CACHE_WORDS or not self.met.all():
            kept = np.flatnonzero(self.met)
            if len(kept) > CACHE_WORDS:
                kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: CACHE_WORDS * 3 // 4]])
            self.parts, self.ids, self.met = self.parts.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.met[kept]
        return ids, places

    def _learn(self, new: list[str]) -> list[list[int]]:
        encoder, out, other = self.encoder, [[]] * len(new), []
        for place, part in enumerate(new):
            if encoder.simple and part.isalpha() and PLAIN.fullmatch(part) and part == part.lower():
                out[place] = encoder.plain(part)
            elif part:
                other.append(place)
        for place, ids in zip(other, encoder.batch([new[k] for k in other])):
            out[place] = ids
        return out


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `PIECE_BYTES` of text; a longer text is one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(batch):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per worker process, so that its tasks share what is known."""
    return WordIds(WordEncoder(path))


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes doc_id, n_tokens, part (number of the file) and ids of every whole text, in ascending doc_id order over all files.

    Null texts are empty; every document ends with `end_id`. Rows with equal ids stand in the order of their
    texts; null ids come first. Other columns are not written. No part holds more than its range of ids, and
    ranges are cut by id and text hash, so equal ids can be cut too.
    """
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    ordered = plain.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            for some in _pieces(batch):
                ids = words.of(some.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids], ["doc_id", "n_tokens", "ids"])
                del ids
                pa.default_memory_pool().release_unused()  # a worker stays, and would keep the most that it ever had

    encoded = ordered.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>")
    encoded.select("doc_id", "n_tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "ids").write.options(**OPTIONS).parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """row, doc_id, start (ids of all documents before it), n_tokens. Reads no ids; files are numbered by one small sum each."""
    counts = spark.read.parquet(folder).select("row", "doc_id", "part", "n_tokens")
    sums = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # one row per file
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return counts.withColumn("inside", inside).join(base, "part").select("row", "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens")


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents; the filter reaches the row groups and page indexes."""
    return spark.read.parquet(folder).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """row and ids_crc32: the CRC-32 of each document's ids as little-endian unsigned 32-bit integers.

    A document's ids travel in rows of `SENT_IDS`, which follow each other, so that the bytes of a batch do not depend
    on the length of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, crc = [], 0  # the document that the next batch may go on with
        for batch in batches:
            rows, ids = batch.column("row").to_numpy(), batch.column("ids")
            firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)])
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            cuts, done = np.append(ends[firsts], ends[-1]).tolist(), []
            for row, a, b in zip(rows[firsts].tolist(), cuts, cuts[1:]):
                if last != [row]:
                    done += [(x, crc) for x in last]
                    last, crc = [row], 0
                crc = zlib.crc32(flat[a:b], crc)
            yield _sums(done)
        yield _sums([(x, crc) for x in last])

    written = spark.read.parquet(folder)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ids"), F.lit(1)), F.lit(SENT_IDS)))
    parts = written.select("row", "ids", first.alias("first")).select("row", F.slice("ids", F.col("first"), SENT_IDS).alias("ids"))
    return parts.mapInArrow(run, "row bigint, ids_crc32 bigint")


def _sums(sums: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1)], ["row", "ids_crc32"])
