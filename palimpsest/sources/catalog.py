"""Extracted catalog relations as parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Explicit schemas: nothing is inferred.
RELATIONS = {
    "columns": "ns_oid bigint, relname string, attname string, attnum int, type_name string, not_null boolean, "
    "identity string, generated_kind string, expression string, is_dropped boolean",
    "constraints": "ns_oid bigint, relname string, conname string, contype string, columns array<string>, expression string, "
    "referenced_table string, referenced_columns array<string>",
    "indexes": "ns_oid bigint, relname string, tablename string, columns array<string>, method string, is_unique boolean, predicate string",
    "enums": "ns_oid bigint, typname string, sortorder double, label string",
    "sequences": "ns_oid bigint, seqname string, data_type string, start bigint, increment bigint, min_value bigint, max_value bigint, cycle boolean",
    "views": "ns_oid bigint, relname string, definition string",
    "functions": "ns_oid bigint, proname string, arguments string, return_type string, language string, definition string",
    "namespaces": "ns_oid bigint, nspname string",
}


def read_catalog(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """All catalog relations of a folder with one parquet table per relation."""
    return {name: spark.read.schema(schema).parquet(f"{directory}/{name}") for name, schema in RELATIONS.items()}


def read_catalog_jdbc(spark: SparkSession, url: str, queries: dict[str, str], bounds: tuple[int, int], partitions: int = 32) -> dict[str, DataFrame]:
    """The same relations from a database, read in parallel by namespace number.

    `queries` maps a relation name to the query that produces its columns.
    """
    low, high = bounds
    return {
        name: spark.read.format("jdbc")
        .options(url=url, dbtable=f"({text}) as {name}", partitionColumn="ns_oid", lowerBound=low, upperBound=high, numPartitions=partitions)
        .load()
        for name, text in queries.items()
    }


def write_catalog(relations: dict[str, DataFrame], directory: str) -> None:
    """Write catalog relations for `read_catalog`."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}")
