"""Filters, joins and set operations over catalog-like relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.session import large


def filter_user_namespaces(df: DataFrame, column: str) -> DataFrame:
    """Drop system namespaces: names starting with `pg_` (a real underscore) and information_schema."""
    name = F.col(column)
    return df.filter(~name.like("pg\\_%") & (name != "information_schema"))


def filter_kinds(df: DataFrame, column: str, kinds: Sequence[str], name: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Keep the listed kinds, without the named bookkeeping objects."""
    kept = df.filter(F.col(column).isin(*kinds))
    return kept.filter(~F.col(name).isin(*exclude)) if name and exclude else kept


def filter_live(df: DataFrame, ordinal: str = "attnum", dropped: str = "is_dropped") -> DataFrame:
    """Keep columns with a positive ordinal that were not dropped."""
    return df.filter((F.col(ordinal) > 0) & ~F.col(dropped))


def derive_flags(df: DataFrame, not_null: str = "not_null", identity: str = "identity") -> DataFrame:
    """nullable = not not_null; is_identity = identity code is not empty."""
    return df.withColumns({"nullable": ~F.col(not_null), "is_identity": F.col(identity) != ""})


def decode_codes(df: DataFrame, column: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Replace codes by names; unknown codes are kept."""
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return df.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)))


def route_by_kind(df: DataFrame, kind: str, code: str, value: str, when_code: str, otherwise: str) -> DataFrame:
    """Put one value into column `when_code` for rows of the kind code, else into `otherwise`."""
    hit = F.col(kind).eqNullSafe(F.lit(code))
    return df.withColumns({when_code: F.when(hit, F.col(value)), otherwise: F.when(~hit, F.col(value))})


def join_parents(child: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner chain child -> parent -> grandparent; each step is (parent, child column, parent key)."""
    return reduce(lambda df, step: df.join(step[0], F.col(step[1]) == F.col(step[2]), "inner"), steps, child)


def join_optional(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Left outer join for optional attributes; `on` pairs left and right columns."""
    return left.join(right, reduce(Column.__and__, [left[a] == right[b] for a, b in on]), "left")


def not_backed_by(df: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows without any match in `other` (NOT EXISTS)."""
    return df.join(other, reduce(Column.__and__, [df[a] == other[b] for a, b in on]), "left_anti")


def drop_orphans(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Child rows with a known parent, and the number of dropped rows as a one-row table."""
    kept = child.join(parent, reduce(Column.__and__, [child[a] == parent[b] for a, b in on]), "left_semi")
    return kept, not_backed_by(child, parent, on).agg(F.count(F.lit(1)).alias("dropped"))


def role_join(df: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, str]) -> DataFrame:
    """Join one dimension once per role; role `r` on column c adds its columns as `r_<column>`."""
    for role, column in roles.items():
        played = dim.select(*[F.col(c).alias(f"{role}_{c}") for c in dim.columns])
        df = df.join(played, F.col(column) == F.col(f"{role}_{key}"), "inner")
    return df


def expand_positions(df: DataFrame, array: str, dim: DataFrame, dim_on: Sequence[tuple[str, str]], position: str) -> DataFrame:
    """Unnest an array of positions with 1-based ordinality and join each to its name.

    `dim_on` pairs further left and dimension columns; `position` is the dimension's position.
    """
    unnested = df.select("*", F.posexplode(array).alias("_pos", "_at")).withColumn("ord", F.col("_pos") + 1).drop("_pos")
    same = [unnested[a] == dim[b] for a, b in dim_on] + [unnested["_at"] == dim[position]]
    return unnested.join(dim, reduce(Column.__and__, same), "inner").drop("_at")


def resolve_by_priority(
    refs: DataFrame, ref_id: Sequence[str], candidates: Column, known: DataFrame, scope: Sequence[str], key: str, keep_unresolved: bool = False
) -> DataFrame:
    """First candidate key, in the order of the array, that exists in `known` under the same scope.

    Adds `resolved`; references without a hit are dropped, or kept with null. The best candidate
    is a minimum per reference, which combines before the shuffle.
    """
    tried = refs.select(*refs.columns, F.posexplode(candidates).alias("_priority", "_candidate"))
    targets = known.select(*[F.col(s).alias(f"_t_{s}") for s in scope], F.col(key).alias("_t_key")).distinct()
    same = [F.col(s) == F.col(f"_t_{s}") for s in scope] + [F.col("_candidate") == F.col("_t_key")]
    hits = tried.join(large(targets, [*[f"_t_{s}" for s in scope], "_t_key"]), reduce(Column.__and__, same), "inner")
    best = hits.groupBy(*ref_id).agg(F.min_by("_candidate", "_priority").alias("resolved"))
    return refs.join(large(best, ref_id), list(ref_id), "left" if keep_unresolved else "inner")


def all_keys(key: str, *sides: tuple[DataFrame, str]) -> DataFrame:
    """Every key any of the sides mentions, once."""
    columns = [df.select(F.col(c).alias(key)) for df, c in sides]
    return reduce(DataFrame.unionByName, columns).distinct()


def stable_order(df: DataFrame, *keys: str) -> DataFrame:
    """Ascending order by several keys (nulls first)."""
    return df.orderBy(*[F.col(k).asc() for k in keys])
