"""Stored migrations and the ledger of applied ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions.names import is_hash


class NoMigrationLedger(Exception):
    """The ledger of applied migrations does not exist, which is not the same as an empty one."""


def with_checksums(migrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Migrations with the checksum of their up text, and rows with a malformed id."""
    valid = is_hash(F.col("migration_id"))
    summed = migrations.filter(valid).select("migration_id", "up_sql", "down_sql", F.sha2("up_sql", 256).alias("checksum"))
    return summed, migrations.filter(~valid)


def write_migrations(migrations: DataFrame, path: str) -> DataFrame:
    """Append migrations with their stored checksum; returns the rows refused for a malformed id."""
    summed, refused = with_checksums(migrations)
    summed.write.mode("append").parquet(path)
    return refused


def read_migrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("migration_id string, up_sql string, down_sql string, checksum string").parquet(path)


def list_migrations(migrations: DataFrame) -> DataFrame:
    """Ids in ascending order."""
    return migrations.select("migration_id").orderBy("migration_id")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table; a missing one is an error of its own."""
    try:
        return spark.read.schema("migration_id string, applied_at timestamp").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise NoMigrationLedger(path) from error
        raise


def applied_ids(ledger: DataFrame) -> DataFrame:
    """Applied ids in ascending order."""
    return ledger.select("migration_id").orderBy("migration_id")
