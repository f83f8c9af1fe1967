"""Content-addressed commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.functions.encoding import content_id, empty_as_absent, packed, unpacked
from palimpsest.functions.names import is_hash
from palimpsest.session import durable

PAYLOAD = ["parents", "schema_hash", "migration_id", "author", "ts", "message", "risk_level"]
HASHES = ("sha", "parents", "schema_hash")  # travel as bytes: in a shuffle hex does not compress


def with_commit_ids(df: DataFrame, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Commits with their hash, and refused rows with a reason.

    The time is taken to UTC; the hash covers the payload, with parents in their given order and
    empty optional fields as absent. Parents must be well-formed hashes; that they exist is checked
    when a ref is set or the history is walked.
    """
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("ts").cast("timestamp_ntz"))
    filled = empty_as_absent(df, ["parents", "migration_id", "risk_level"]).withColumn("ts", F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    parents = F.coalesce("parents", F.array().cast("array<string>"))
    reason = F.when(~is_hash(F.col("schema_hash")), "invalid schema hash").when(F.exists(parents, lambda p: ~is_hash(p)), "invalid parent hash")
    judged = filled.withColumn("reason", reason)
    written = judged.filter("reason is null").drop("reason")
    return written.withColumn("sha", content_id(written, PAYLOAD)), judged.filter("reason is not null")


def verify_commits(commits: DataFrame) -> DataFrame:
    """Commits whose payload no longer gives their hash."""
    return commits.withColumn("actual", content_id(commits, PAYLOAD)).filter(~F.col("sha").eqNullSafe(F.col("actual")))


def _hashes(df: DataFrame, change: Callable[[Column], Column], kind: str) -> DataFrame:
    """`df` with `change` made to hashes and lists of hashes, where they are of a type."""
    lists = {n: F.transform(F.col(n), change) for n, t in df.dtypes if n in HASHES and t == f"array<{kind}>"}
    return df.withColumns(lists | {n: change(F.col(n)) for n, t in df.dtypes if n in HASHES and t == kind})


def write_commits(commits: DataFrame, path: str) -> None:
    """Append commits, partitioned by hash prefix."""
    prefixed = _hashes(commits.withColumn("prefix", F.substring("sha", 1, 2)), packed, "string").hint("rebalance", F.col("prefix"))
    _hashes(prefixed, unpacked, "binary").write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(path)


def read_commits(spark: SparkSession, path: str, shas: DataFrame | None = None) -> DataFrame:
    """Stored commits, each once however often it was written; of `shas` (column `sha`) only these, from their prefix folders."""
    stored = spark.read.parquet(path)
    if shas is not None:
        wanted = durable(shas.select("sha", F.substring("sha", 1, 2).alias("prefix")).distinct())
        folders = [r["prefix"] for r in wanted.select("prefix").distinct().collect()]  # two digits: at most 256
        stored = stored.where(F.lpad(F.col("prefix").cast("string"), 2, "0").isin(folders)).join(wanted.select("sha"), "sha", "left_semi")
    return _hashes(_hashes(stored.drop("prefix"), packed, "string").dropDuplicates(["sha"]), unpacked, "binary")
