"""Content-addressed objects: objects(sha, content) by hash prefix, with an index of their hashes.

The index (`sha`, length, SHA-512 of the bytes) is a table bucketed by `sha`. A batch is dealt out to the same buckets
and joined with it in place: the store side of the join is read as it lies, without a shuffle and without any content,
and only in the columns that tell whether bytes are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.functions.encoding import content_id

PREFIX_DIGITS = 2
BUCKETS = 64  # of an index; a store keeps the number it began with


def fingerprint(content: Column) -> Column:
    """What tells bytes of one hash apart: their length and SHA-512."""
    return F.concat(F.octet_length(content).cast("string"), F.lit(":"), F.sha2(content, 512))


def _offered(objects: DataFrame, content: str) -> DataFrame:
    """Copies within a batch are combined before the shuffle."""
    rows = objects.select(F.sha2(F.col(content), 256).alias("sha"), F.col(content).alias("content")).withColumn("_bytes", fingerprint(F.col("content")))
    return rows.groupBy("sha", "_bytes").agg(F.first("content").alias("content"))


def _judged(offered: DataFrame, held: DataFrame) -> DataFrame:
    """Offered objects against (sha, low, high): the least and largest fingerprint stored under a hash."""
    same = (F.col("low") == F.col("_bytes")) & (F.col("high") == F.col("_bytes"))
    outcome = F.when(F.col("low").isNull(), "new").when(same, "existing").otherwise("collision")
    return offered.join(held, "sha", "left").select("sha", "content", outcome.alias("outcome"))


def put_if_absent(objects: DataFrame, store: DataFrame, content: str = "content") -> DataFrame:
    """Outcome per distinct content: sha, content, outcome `new`, `existing` or `collision`.

    A collision is a stored object with this hash and other bytes. `store` is any table of (sha, content): contents are
    read and hashed where they lie, and never shuffled. With a store that keeps an index use `put_into`, which reads no
    content at all. A store should hold one object per hash; with several, any other bytes are a collision.
    """
    stored = store.select("sha", fingerprint(F.col("content")).alias("b"))
    return _judged(_offered(objects, content), stored.groupBy("sha").agg(F.min("b").alias("low"), F.max("b").alias("high")))


def put_into(objects: DataFrame, index: str, content: str = "content") -> DataFrame:
    """The same against the index table of a store: its buckets are joined as they lie, and no content is read."""
    spark = objects.sparkSession
    held = spark.table(index).groupBy("sha").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return _judged(_offered(objects, content), held)


def create_index(spark: SparkSession, index: str, path: str, buckets: int = BUCKETS) -> None:
    """An empty index table, bucketed and sorted by hash, with its files in `path`."""
    empty = spark.createDataFrame([], "sha string, bytes string")
    empty.write.bucketBy(buckets, "sha").sortBy("sha").option("path", path).format("parquet").saveAsTable(index)


def append_index(outcomes: DataFrame, index: str, buckets: int = BUCKETS) -> None:
    """Adds the new objects of a batch to the index; `buckets` is the number it was made with.

    To be called after the objects are appended: an object without an index row is offered again and stored twice with equal
    bytes, which readers take as one; an index row without its object would lose it.
    """
    fresh = outcomes.filter("outcome = 'new'").select("sha", fingerprint(F.col("content")).alias("bytes"))
    fresh.repartition(buckets, "sha").write.mode("append").bucketBy(buckets, "sha").sortBy("sha").format("parquet").saveAsTable(index)


def append_new(outcomes: DataFrame, path: str, digits: int = PREFIX_DIGITS) -> None:
    """Append the new objects of `put_if_absent`; one writer per store, with one prefix length."""
    fresh = outcomes.filter("outcome = 'new'").select("sha", "content", F.substring("sha", 1, digits).alias("prefix"))
    # Rebalancing keeps few files per prefix and still splits what is too large for one task.
    fresh.hint("rebalance", F.col("prefix")).write.mode("append").partitionBy("prefix").parquet(path)


def read_objects(spark: SparkSession, path: str, sha: str | None = None, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Stored objects; a single hash reads its prefix folder only."""
    stored = spark.read.schema("sha string, content string, prefix string").parquet(path)
    if sha is None:
        return stored.select("sha", "content")
    return stored.filter((F.col("prefix") == sha[:digits]) & (F.col("sha") == sha)).select("sha", "content")


def verify_objects(store: DataFrame, stored: str = "sha", content: str | Sequence[str] = "content") -> DataFrame:
    """Rows whose content no longer gives the stored hash; adds `actual`.

    One column is hashed as it is; several columns by their row encoding.
    """
    actual = F.sha2(F.col(content), 256) if isinstance(content, str) else content_id(store, content)
    return store.withColumn("actual", actual).filter(~F.col(stored).eqNullSafe(F.col("actual")))
