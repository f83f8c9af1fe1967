"""Nested schema documents from flat catalog relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.functions.names import object_id
from palimpsest.operators.aggregates import nest
from palimpsest.operators.ordinals import densify
from palimpsest.session import durable, large


def canonical_order(value: Column, dtype: T.DataType) -> Column:
    """Sort every nested list of objects by id; lists of plain values keep their order."""
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[canonical_order(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if not isinstance(element, T.StructType):
            return value
        ordered = F.transform(value, lambda item: canonical_order(item, element))
        if "id" not in element.fieldNames():
            return ordered

        def by_id(left: Column, right: Column) -> Column:
            return F.when(left["id"] < right["id"], -1).when(left["id"] > right["id"], 1).otherwise(0)

        return F.array_sort(ordered, by_id)
    return value


def assemble_tables(columns: DataFrame, constraints: DataFrame, indexes: DataFrame, limit: int | None = None) -> DataFrame:
    """One document row per table and part: nspname, relname, id, part, columns, constraints, indexes.

    columns(nspname, relname, name, type, nullable, default), constraints(…, name, type, columns),
    indexes(…, name, columns, method, unique, predicate). A table exists through its columns;
    constraints and indexes of unknown tables are skipped. Members are sorted by id.
    """
    table = ["nspname", "relname"]

    def identified(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn("id", object_id(kind, F.col("nspname"), F.col("relname"), F.col("name")))

    # Each relation is counted, joined and gathered: computing it once is cheaper than its lineage.
    columns, constraints, indexes = durable(columns), durable(constraints), durable(indexes)
    tables = durable(columns.select(*table).distinct())
    ranked = densify(identified(columns, "column"), table, ["id"], limit=limit)
    column = F.struct("id", "name", "ordinal", "type", "nullable", "default")
    constraint = F.struct("id", "name", "type", "columns")
    index = F.struct("id", "name", "columns", "method", "unique", "predicate")
    known = lambda df: df.join(large(tables, table), table, "left_semi")
    nested = nest(
        tables,
        table,
        limit,
        columns=(ranked, column, ["id"]),
        constraints=(identified(known(constraints), "constraint"), constraint, ["id"]),
        indexes=(identified(known(indexes), "index"), index, ["id"]),
    )
    return nested.withColumn("id", object_id("table", F.col("nspname"), F.col("relname")))


def assemble_namespaces(tables: DataFrame, views: DataFrame, enums: DataFrame, sequences: DataFrame, limit: int | None = None) -> DataFrame:
    """One document row per namespace and part: id, name, part, tables, views, enums, sequences.

    Each input has `nspname` and `id`; its other columns become the member object. A namespace
    exists as soon as any kind of object mentions it.
    """
    kinds = {name: durable(df) for name, df in {"tables": tables, "views": views, "enums": enums, "sequences": sequences}.items()}
    names = None
    for df in kinds.values():
        seen = df.select("nspname")
        names = seen if names is None else names.unionByName(seen)
    members = {}
    for kind, df in kinds.items():
        rest = [c for c in df.columns if c not in ("nspname", "id", "part")]
        order = ["id", "part"] if "part" in df.columns else ["id"]
        members[kind] = (df, F.struct("id", *rest), order)
    nested = nest(names.distinct(), ["nspname"], limit, **members)
    return nested.withColumn("id", object_id("namespace", F.col("nspname")))
