"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, under a softmax.

Numpy trains by stochastic gradient descent on a bounded sample of labelled texts. A trained model is
linear in the average, so a word's n-grams add up to one number per word; tasks score whole texts by
adding these numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRAIN_ROWS = 4000  # labelled texts taken for training, spread by a hash of their ids
SENT_BYTES = 40_000  # longer texts of the sample are counted in tasks and reach the driver as counts per bucket
BUCKETS = 1 << 15
DIMENSIONS = 8
GRAMS = (2, 3, 4)  # lengths of character n-grams, with < and > around the word
EPOCHS, LEAST_STEPS, RATE = 6, 20_000, 0.5  # passes over the sample, more of them if it is small
CACHE_WORDS = 400_000  # words whose features or scores a task remembers


def grams(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    data = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in data]


def counts(text: str | None, cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs. Words are counted first, so memory grows with different ones only."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for word, times in Counter((text or "").split()).items():
        known = cache.get(word)
        if known is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            known = cache[word] = grams(word)
        np.add.at(total, known, times)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def features(text: str | None, cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found: list[int] = []
    for word in (text or "").split():
        known = cache.get(word)
        if known is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            known = cache[word] = grams(word)
        found.extend(known)
    buckets, counts = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    return buckets, counts / max(1, len(found))


@dataclass
class Model:
    weights: np.ndarray  # per bucket: what it adds to the log-odds of label 1
    bias: float


def train(rows: list[tuple[str | None | tuple[np.ndarray, np.ndarray], int]], seed: int = 7) -> Model:
    """A model of (text, label 0/1) rows; a text may also be given as its `counts`. Without rows it says one half of everything."""
    cache: dict[str, list[int]] = {}
    given = [((text[0], text[1] / max(1, text[1].sum())) if isinstance(text, tuple) else features(text, cache), label) for text, label in rows]
    data = [(*found, label) for found, label in given]
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    output, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    epochs = max(EPOCHS, LEAST_STEPS // max(1, len(data)))
    total, step = epochs * len(data), 0
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            buckets, shares, label = data[i]
            rate = RATE * (1 - step / total)
            step += 1
            hidden = shares @ embedding[buckets]
            logits = hidden @ output + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= rate * error
            embedding[buckets] -= (rate * shares)[:, None] * back
    return Model((embedding @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


class _WordScores(dict):
    """Scores of words, reckoned when first asked for: a complex number of the sum over its features and their count."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> complex:
        if len(self) >= CACHE_WORDS:
            self.clear()
        buckets = grams(word)
        value = self[word] = complex(sum(map(self.weights.__getitem__, buckets)), len(buckets))
        return value


def training_rows(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, rows: int = TRAIN_ROWS) -> list[tuple[str | tuple[np.ndarray, np.ndarray], int]]:
    """At most `rows` labelled texts, by the hash of their ids; texts beyond SENT_BYTES as their `counts`.

    Labels meet the ids of documents before the sample is drawn, so labels of other documents take no place in it.
    Null ids, null texts and labels other than 0 and 1 teach nothing; an id with both labels teaches both, repeated rows
    of a document count as often as they stand there. A row of the sample takes at most 8 bytes per bucket on its way.
    """
    marked = labels.select(F.col(f"`{label_id}`").alias("_id"), F.col(f"`{label}`").alias("_label")).where("_label in (0, 1) and _id is not null")
    plain = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).where("_text is not null")
    chosen = marked.distinct().join(plain.select("_id"), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    sample = plain.join(F.broadcast(chosen), "_id").select("_id", F.col("_label").cast("int").alias("_label"), F.xxhash64("_text").alias("_hash"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            texts, found = batch.column(3), []
            for i in range(len(batch)):
                own = texts[i].as_py()
                long = len(own.encode("utf-8", "replace")) > SENT_BYTES
                buckets, times = counts(own, cache) if long else (None, None)
                found.append((None, buckets.astype("<u4").tobytes(), times.astype("<u4").tobytes()) if long else (own, None, None))
            kinds = (pa.string(), pa.binary(), pa.binary())
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["_id", "_label", "_hash", "_text", "_buckets", "_counts"])

    kind = sample.schema["_id"].dataType.simpleString()
    slim = sample.mapInArrow(run, f"_id {kind}, _label int, _hash bigint, _text string, _buckets binary, _counts binary")
    read = lambda data: np.frombuffer(bytes(data), "<u4").astype(np.int64)
    ordered = slim.orderBy(F.xxhash64("_id"), "_id", "_label", "_hash").limit(rows).collect()
    return [(r["_text"] if r["_buckets"] is None else (read(r["_buckets"]), read(r["_counts"])), r["_label"]) for r in ordered]


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`documents` without `text`, with `name`: the probability of label 1, from the whole text.

    Texts that are null or hold no word get the model's bias alone. Repeated rows score alike; a column
    called `name` is replaced.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    others = [c for c in documents.columns if c not in (text, name)]
    last = "_" * (1 + max(map(len, documents.columns)))  # a name that no column has
    slim = documents.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias(last))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        words = _WordScores(weights)
        for batch in batches:
            out = np.empty(len(batch))
            texts = batch.column(len(others))
            for i in range(len(batch)):
                total = sum(map(words.__getitem__, (texts[i].as_py() or "").split()), 0j)
                z = bias + total.real / max(1.0, total.imag)
                out[i] = 1 / (1 + np.exp(-z)) if z > -700 else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(out)], [*others, name])

    return slim.mapInArrow(run, f"{fields}{', ' if fields else ''}`{name}` double")
