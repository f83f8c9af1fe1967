"""Hashes of whole schemas, from the bottom up: members, tables, namespaces, schema.

A node's hash covers its own fields and, per kind of member, the number of members and the sum of their hashes. Sums
combine before the shuffle and do not depend on order, so no document is ever put together, and a table or namespace
of any size is one small row. Empty optional fields count as absent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.encoding import content_id, empty_as_absent
from palimpsest.operators.fingerprints import group_hash


@dataclass(frozen=True)
class Kind:
    """Fields of a kind of object in the order they are hashed, with their types; `optional` ones may be absent."""

    fields: dict[str, str]
    optional: tuple[str, ...] = ()


# A column's ordinal is the rank of its name, so it adds nothing to a hash.
IN_TABLE = {
    "columns": Kind({"id": "string", "name": "string", "type": "string", "nullable": "boolean", "default": "string", "is_identity": "boolean", "generated": "string"}, ("default", "is_identity", "generated")),
    "constraints": Kind({"id": "string", "name": "string", "type": "string", "columns": "array<string>", "expression": "string", "referenced_table": "string", "referenced_columns": "array<string>"}, ("columns", "expression", "referenced_table", "referenced_columns")),
    "indexes": Kind({"id": "string", "name": "string", "columns": "array<string>", "method": "string", "unique": "boolean", "predicate": "string"}, ("columns", "method", "unique", "predicate")),
}
IN_NAMESPACE = {
    "views": Kind({"id": "string", "name": "string", "definition": "string", "depends_on": "array<string>"}, ("depends_on",)),
    "enums": Kind({"id": "string", "name": "string", "values": "array<string>"}),
    "sequences": Kind({"id": "string", "name": "string", "data_type": "string", "start": "bigint", "increment": "bigint", "min_value": "bigint", "max_value": "bigint", "cycle": "boolean"}),
    "functions": Kind({"id": "string", "name": "string", "arguments": "array<string>", "return_type": "string", "language": "string", "definition": "string"}, ("arguments",)),
}


def _members(df: DataFrame, kind: Kind, parent: list[str], name: str) -> DataFrame:
    """parent, <name>: one hash over all members of a parent."""
    shaped = df.select(*parent, *[(F.col(f"`{f}`").cast(t) if f in df.columns else F.lit(None).cast(t)).alias(f) for f, t in kind.fields.items()])
    return group_hash(empty_as_absent(shaped, kind.optional), parent, list(kind.fields), name).select(*parent, F.col(f"{name}_hash").alias(name))


def table_hashes(tables: DataFrame, **members: DataFrame) -> DataFrame:
    """nspname, relname, id, name, hash of each row of `tables` (nspname, relname, id, name) with its columns, constraints and indexes.

    Members carry nspname, relname and the fields of their kind; fields that are missing are absent. Members of unknown
    tables are passed over.
    """
    parent = ["nspname", "relname"]
    rows = tables.select(*parent, "id", "name")
    for kind in IN_TABLE:
        rows = rows.join(_members(members[kind], IN_TABLE[kind], parent, kind), parent, "left") if kind in members else rows.withColumn(kind, F.lit(None).cast("string"))
    return rows.select(*parent, "id", "name", content_id(rows, ["id", "name", *IN_TABLE]).alias("hash"))


def namespace_hashes(namespaces: DataFrame, tables: DataFrame, **members: DataFrame) -> DataFrame:
    """nspname, id, hash of each row of `namespaces` (nspname, id) with its tables (`table_hashes`), views, enums, sequences and functions."""
    parent = ["nspname"]
    rows = namespaces.select("nspname", "id").withColumn("name", F.col("nspname"))
    own = group_hash(tables.select("nspname", "id", "hash"), parent, ["id", "hash"], "tables").select("nspname", F.col("tables_hash").alias("tables"))
    rows = rows.join(own, parent, "left")
    for kind in IN_NAMESPACE:
        rows = rows.join(_members(members[kind], IN_NAMESPACE[kind], parent, kind), parent, "left") if kind in members else rows.withColumn(kind, F.lit(None).cast("string"))
    return rows.select("nspname", "id", content_id(rows, ["id", "name", "tables", *IN_NAMESPACE]).alias("hash"))


def schema_hash(namespaces: DataFrame) -> DataFrame:
    """One row: number of namespaces and hash of the whole schema, from `namespace_hashes`."""
    whole = group_hash(namespaces.select(F.lit(1).alias("one"), "id", "hash"), ["one"], ["id", "hash"], "schema")
    found = whole.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("namespaces"), F.coalesce(F.max("schema_hash"), F.sha2(F.lit(""), 256)).alias("hash"))
    return found
