"""Line dedup by distinct-site spread: boilerplate lines that stand on many sites are removed.

One sketch of sites per line hash; sketches merge in the aggregation, so a line on a third of all
pages costs one row per task. A line whose estimate lies near the threshold is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.expressions import has_word, let
from palimpsest.session import durable

MIN_SITES = 8
LG_K = 12  # 2**12 registers: a relative standard error of 1.6 per cent
NEAR = 0.1  # estimates within this share of the threshold, or one site of it, are counted exactly


def _lines(documents: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, text_hash, site, pos, h, g (a 96-bit hash of the line)."""
    cut = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.where(has_word(F.col("line"))).select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least `min_sites` sites: h, g, first (smallest doc_id that has the line)."""
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("first"))
    slack = max(1.0, NEAR * min_sites)
    judged = durable(spread.select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - slack))
    near = judged.where(F.col("sites") <= min_sites + slack)
    exact = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "site").distinct()
    exact = exact.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h", "g")
    sure = judged.where(F.col("sites") > min_sites + slack).select("h", "g")
    return judged.select("h", "g", "first").join(sure.union(exact), ["h", "g"], "left_semi")


def remove_boilerplate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`documents` with boilerplate lines taken out of `text`, and two more columns: lines_seen, lines_removed.

    A line is what stands between newlines, compared as it is; lines without a word are never removed.
    The document with the smallest id keeps its copy of each line, so nothing is lost everywhere. A
    null text stays null (0 lines); null sites count as one site; documents with a null id keep a line
    only if no other document has it. Equal rows are treated alike and all stay. A text that loses
    every line becomes empty.
    """
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("none")).alias("site"))
    lines = _lines(plain)
    flagged = durable(boilerplate(lines, min_sites))
    gone = lines.join(flagged, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_gone"))
    joined = documents.join(gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    kept = let(
        F.split(F.col(text), "\n"),
        lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_gone")), lambda i: F.get(all_, i)), "\n"),
    )
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else documents[c] for c in documents.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).cast("bigint").alias("lines_seen"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("lines_removed"),
    )
