"""From raw documents to token pieces in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.llm import containment, decision_list, line_spread, nbest, trie_join  # noqa: E402
from palimpsest.llm.expressions import WORD  # noqa: E402
from palimpsest.llm.queries import vocabulary  # noqa: E402
from palimpsest.session import shared_folder  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return decision_list.judged(docs, labels, carry=True).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines are taken out; a document that held nothing else goes. n_chars follows the text."""
    cleaned = line_spread.remove_boilerplate(docs)
    left = cleaned.where((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    columns = [F.when(F.col("lines_removed") > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id (null only if all are), then text hash, once. Documents without words all stay."""
    grouped = trie_join.near_duplicates(docs).where("label is not null")
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    same = docs.where(worded).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
    return same.dropDuplicates(["doc_id", "text"]).union(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = containment.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, costs (of the n best segmentations) and ids (of the best)."""
    encoded = nbest.encode(docs, vocabulary("piece_bpe_32k.model"), others=("lang", "source"))
    best = F.col("n_best")[0]["ids"]
    return encoded.select("doc_id", "lang", "source", F.size(best).cast("bigint").alias("n_pieces"), F.transform("n_best", lambda x: x["cost"]).alias("costs"), best.alias("ids"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pieces", pieces)]

#: The learned list and the piece search are beyond SQL. Tests compare the kept rows of near_duplicates on a small table;
#: of the other stages before pieces only columns and counts. pieces and run() are not tested here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written below the session's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
