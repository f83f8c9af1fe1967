"""What the learned operators make of samples, partitions, long texts and given models, against plain Python."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import decision_list, subword_classifier as sc
from palimpsest.llm.decision_list import Condition


def test_thresholds_do_not_depend_on_partitions(spark):
    rows = [(x, (x * 37) % 101, (x * x) % 997, (x * x) % 997 > 800, x % 3) for x in range(4000)]
    frame = spark.createDataFrame(rows, "a long, b long, c long, bad boolean, fold int")
    found = [decision_list.learn(frame.repartition(n), ("a", "b", "c")) for n in (1, 7, 23)]
    assert found[0] and found[0] == found[1] == found[2]
    (rule,) = found[0]
    ordered = sorted(r[2] for r in rows)  # cuts are the quantiles i / 32 between neighbours, rounded up
    places = [(len(ordered) - 1) * i / (decision_list.CUTS + 1) for i in range(1, decision_list.CUTS + 1)]
    cuts = {math.ceil(ordered[int(p)] + (ordered[min(int(p) + 1, len(ordered) - 1)] - ordered[int(p)]) * (p - int(p))) for p in places}
    assert all(c.feature != "c" or c.value in cuts for c in rule)


def test_implied_conditions_go():
    a, b, c, d = Condition("x", True, 57), Condition("x", True, 67), Condition("x", False, 90), Condition("y", False, 5)
    assert decision_list._tightest([a, d, b, c]) == [d, b, c]
    assert decision_list._tightest([c, Condition("x", False, 80)]) == [Condition("x", False, 80)]
    assert decision_list._tightest([]) == []


def test_labels_of_other_documents_take_no_place(spark):
    documents = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = sc.training_rows(documents, labels, "doc_id", "text", "doc_id", "quality", 50)
    assert len(rows) == 50 and all(int(t.split()[1]) % 2 == label for t, label in rows)
    assert sc.training_rows(documents.limit(0), labels, "doc_id", "text", "doc_id", "quality") == []
    assert sc.training_rows(documents, labels.limit(0), "doc_id", "text", "doc_id", "quality") == []
    odd = spark.createDataFrame([(1, 2), (None, 1), (2, None), (3, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    assert sorted(sc.training_rows(documents, odd, "doc_id", "text", "doc_id", "quality")) == [("text 3", 0), ("text 3", 1)]


def test_long_texts_teach_as_counts(spark):
    long = " ".join(f"word{i % 700} é{i}" for i in range(8000))
    assert len(long) > sc.SENT_BYTES
    documents = spark.createDataFrame([(1, long), (2, "short text"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    rows = sc.training_rows(documents, labels, "doc_id", "text", "doc_id", "quality")
    (sent,) = [t for t, label in rows if label == 0]
    buckets, shares = sc.features(long, {})
    assert (sent[0] == buckets).all() and np.allclose(sent[1] / sent[1].sum(), shares)
    assert sorted(t for t, label in rows if label == 1) == ["", "short text"]
    plain = sc.train([(long if isinstance(t, tuple) else t, label) for t, label in rows])
    counted = sc.train(rows)
    assert np.allclose(plain.weights, counted.weights) and abs(plain.bias - counted.bias) < 1e-9


def test_scores_are_averages_of_gram_weights(spark):
    model = sc.train([("good words here", 1), ("bad### junk###", 0)] * 50)
    texts = [None, "", " ", "good", "words words junk###", "é 梦 ▁", "a " * 30_000 + "junk###"]

    def expected(text):
        weights = []
        for word in (text or "").split():
            marked = f"<{word}>"
            parts = [marked] + [marked[i : i + n] for n in sc.GRAMS for i in range(len(marked) - n + 1)]
            weights += [model.weights[zlib.crc32(p.encode()) % sc.BUCKETS] for p in parts]
        return 1 / (1 + math.exp(-(model.bias + (sum(weights) / len(weights) if weights else 0.0))))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in sc.score(frame, model).collect():
        assert abs(row["score"] - expected(texts[row["doc_id"]])) < 1e-9
