"""Stored merge conflicts, one partition per merge and keyed by the real object id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "object_id string, kind string, base string, ours string, theirs string, fields array<string>, message string, merge_id string"


def _nothing(spark: SparkSession, merge_id: str) -> DataFrame:
    """One row of no object, which readers skip: it makes a merge without conflicts overwrite its partition too."""
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMA).schema if f.name != "merge_id"]
    return spark.range(1).select(*fields, F.lit(merge_id).alias("merge_id"))


def write_conflicts(conflicts: DataFrame, merge_id: str, path: str) -> None:
    """Replace all conflicts of one merge in a single write; no conflicts clears it. Until the write commits, the old ones stay.

    Spark names the partition's folder in every write, so ids with any characters are found again.
    """
    rows = _nothing(conflicts.sparkSession, merge_id)
    named = conflicts.withColumn("merge_id", F.lit(merge_id)).select(*rows.columns)
    named.unionByName(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("merge_id").parquet(path)


def read_conflicts(spark: SparkSession, path: str, merge_id: str | None = None) -> DataFrame:
    """Stored conflicts in object-id order."""
    stored = spark.read.schema(SCHEMA).parquet(path).filter("object_id is not null")  # every merge holds one empty row
    if merge_id is not None:
        stored = stored.filter(F.col("merge_id") == merge_id)
    return stored.orderBy("object_id")


def clear_conflicts(spark: SparkSession, merge_id: str, path: str) -> None:
    """Remove the conflicts of one merge."""
    write_conflicts(spark.createDataFrame([], SCHEMA).drop("merge_id"), merge_id, path)
