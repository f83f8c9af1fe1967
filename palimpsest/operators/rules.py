"""Rules over metadata rows; every rule returns (rule, object_id, field, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.aggregates import count_where, duplicates
from palimpsest.session import large

# Constraint kinds of the model.
CONSTRAINT_KINDS = ("pk", "unique", "check", "fk")

# Sequence types with their default bounds.
SEQUENCE_BOUNDS = {
    "int8": (1, 9223372036854775807),
    "int4": (1, 2147483647),
    "int2": (1, 32767),
}


def violations(df: DataFrame, rule: str, object_id: Column, field: Column | str, detail: Column | str) -> DataFrame:
    """Shape rows as violations."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.lit(rule).alias("rule"),
        object_id.cast("string").alias("object_id"),
        as_column(field).cast("string").alias("field"),
        as_column(detail).cast("string").alias("detail"),
    )


def report(*found: DataFrame) -> DataFrame:
    """All violations of several rules in one table."""
    return reduce(DataFrame.unionByName, found)


def _per_field(df: DataFrame, rule: str, object_id: Column, tests: Mapping[str, Column], detail: str) -> DataFrame:
    """One violation per row and failing field, in one pass over the rows."""
    failing = F.array_compact(F.array(*[F.when(bad, F.lit(field)) for field, bad in tests.items()]))
    rows = df.select(object_id.alias("_id"), F.explode(failing).alias("_field"))
    return violations(rows, rule, F.col("_id"), F.col("_field"), detail)


def required(df: DataFrame, object_id: Column, fields: Sequence[str]) -> DataFrame:
    """Required fields must be present."""
    return _per_field(df, "required", object_id, {f: F.col(f).isNull() for f in fields}, "missing")


def min_length(df: DataFrame, object_id: Column, fields: Sequence[str]) -> DataFrame:
    """Ids, names and types have at least one character."""
    return _per_field(df, "min_length", object_id, {f: F.col(f) == "" for f in fields}, "empty")


def minimum(df: DataFrame, object_id: Column, field: str, least: int) -> DataFrame:
    """A number is at least `least`."""
    return violations(df.filter(F.col(field) < least), "minimum", object_id, field, F.col(field))


def domain(df: DataFrame, object_id: Column, field: str, allowed: Sequence[str] = CONSTRAINT_KINDS) -> DataFrame:
    """A value belongs to a closed list."""
    return violations(df.filter(~F.col(field).isin(*allowed)), "domain", object_id, field, F.col(field))


# Kinds that a declared number accepts.
ACCEPTED = {"DOUBLE": ("DOUBLE", "FLOAT", "DECIMAL", "BIGINT"), "DECIMAL": ("DECIMAL", "BIGINT")}


def value_kinds(df: DataFrame, object_id: Column, json: str, kinds: Mapping[str, str]) -> DataFrame:
    """Declared JSON fields hold values of the declared kind (BIGINT, DOUBLE, STRING, BOOLEAN, …); null and absent pass.

    A whole number is also a DOUBLE or DECIMAL, and 1.5 (a decimal) a DOUBLE. A text that is no JSON is one row with
    the whole column as field and `malformed` as detail; a null text passes.
    """
    variant = F.try_parse_json(json)
    paths = {f: F.regexp_replace(F.schema_of_variant(F.try_variant_get(variant, f"$.{f}", "variant")), r"\(.*", "") for f in kinds}
    found = [F.when(F.col(json).isNotNull() & variant.isNull(), F.struct(F.lit(json).alias("field"), F.lit("malformed").alias("detail")))]
    found += [F.when(~kind.isin(*ACCEPTED.get(kinds[f], (kinds[f],)), "VOID"), F.struct(F.lit(f).alias("field"), F.lit("wrong kind").alias("detail"))) for f, kind in paths.items()]
    rows = df.select(object_id.alias("_id"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return violations(rows, "value_kind", F.col("_id"), F.col("x.field"), F.col("x.detail"))


def defined_twice(df: DataFrame, object_id: str) -> DataFrame:
    """An object is defined once."""
    again = duplicates(df, [object_id], "_times")
    return violations(again, "defined_twice", F.col(object_id), object_id, F.col("_times"))


def single_pk(constraints: DataFrame, table: Sequence[str], table_id: Column, kind: str = "contype") -> DataFrame:
    """A table has at most one primary key."""
    many = count_where(constraints, table, F.col(kind) == "pk", 1, "_keys")
    return violations(many, "single_pk", table_id, kind, F.col("_keys"))


def known_columns(members: DataFrame, table: Sequence[str], member_id: Column, columns: str, live: DataFrame, name: str) -> DataFrame:
    """Columns named by keys and indexes exist in their table."""
    named = members.select(*table, member_id.alias("_id"), F.explode(columns).alias("_column"))
    there = live.select(*table, F.col(name).alias("_column"))
    return violations(named.join(large(there, [*table, "_column"]), [*table, "_column"], "left_anti"), "known_column", F.col("_id"), columns, F.col("_column"))


def known_parent(members: DataFrame, table: Sequence[str], member_id: Column, tables: DataFrame) -> DataFrame:
    """The table of an index exists."""
    return violations(members.join(large(tables, table), list(table), "left_anti"), "known_parent", member_id, table[-1], F.col(table[-1]))


def fk_arity(constraints: DataFrame, constraint_id: Column, columns: str, referenced: str, kind: str = "contype") -> DataFrame:
    """Both column lists of a foreign key are non-empty and equally long."""
    own, other = F.coalesce(F.size(columns), F.lit(0)), F.coalesce(F.size(referenced), F.lit(0))
    bad = constraints.filter((F.col(kind) == "fk") & ((own == 0) | (own != other)))
    return violations(bad, "fk_arity", constraint_id, columns, F.concat_ws(":", own.cast("string"), other.cast("string")))


def fk_target(constraints: DataFrame, constraint_id: Column, referenced_table: str, kind: str = "contype") -> DataFrame:
    """A foreign key names its table."""
    bad = constraints.filter((F.col(kind) == "fk") & F.col(referenced_table).isNull())
    return violations(bad, "fk_target", constraint_id, referenced_table, "missing")


def has_members(parents: DataFrame, keys: Sequence[str], parent_id: Column, members: DataFrame, what: str) -> DataFrame:
    """A table has columns; an enum has values."""
    return violations(parents.join(large(members, keys), list(keys), "left_anti"), "has_members", parent_id, what, "none")


def sequence_rules(df: DataFrame, sequence_id: Column, data_type: str = "data_type", increment: str = "increment") -> DataFrame:
    """Sequence type is supported and the increment is not zero."""
    tests = {data_type: ~F.col(data_type).isin(*SEQUENCE_BOUNDS), increment: F.col(increment) == 0}
    return _per_field(df, "sequence", sequence_id, tests, "unsupported")


def with_sequence_bounds(df: DataFrame, data_type: str = "data_type", low: str = "min_value", high: str = "max_value") -> DataFrame:
    """Fill missing bounds with the defaults of the type."""

    def default(position: int) -> Column:
        pairs = [F.lit(v) for name, bounds in SEQUENCE_BOUNDS.items() for v in (name, bounds[position])]
        table = F.create_map(*pairs).cast("map<string,bigint>")
        return F.try_element_at(table, F.col(data_type))

    return df.withColumns({low: F.coalesce(F.col(low), default(0)), high: F.coalesce(F.col(high), default(1))})
