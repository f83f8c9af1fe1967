"""Comparing, merging and patching versions of keyed tables.

All sides of a comparison are stacked and grouped by key once, so two or three versions cost one
shuffle, without a sort before it. `diff` ships keys and row hashes only. Keys must be unique on each
side; a repeated key stops the job with its value. Versions stored by `version_store` are compared
range by range first, so only ranges that differ come here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.session import dealt, large


def row_hashes(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    """Two independent 64-bit hashes of the columns other than `skip`; nulls count by their place.

    Types that Spark does not hash (maps, variants) are hashed by their JSON text.
    """
    def hashable(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        return F.to_json(F.struct(F.col(f"`{name}`").alias("v"))) if "map<" in kind or "variant" in kind else F.col(f"`{name}`")

    columns = [hashable(c) for c in df.columns if c not in skip]
    nested = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in df.columns if c not in skip and df.schema[c].dataType.typeName() in ("struct", "array")]
    marks = [c.isNull() for c in columns]  # the hash passes over nulls, inside lists and structs too
    return [F.xxhash64(F.lit(seed), *columns, *nested, *marks) for seed in (1, 2)]


def _key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])


def align(keys: Sequence[str], **sides: DataFrame) -> DataFrame:
    """One row per key with one struct of the other columns per side (null where absent)."""
    names = list(sides)
    values = [c for c in sides[names[0]].columns if c not in keys]
    stacked = reduce(
        DataFrame.unionByName,
        [
            side.select(*keys, F.lit(i).alias("_side"), F.struct(*[F.col(f"`{v}`") for v in values]).alias("_row"))
            for i, side in enumerate(sides.values())
        ],
    )
    # Keys are unique, so nothing can be combined before the shuffle: rows are dealt out as they are and sorted once.
    found = dealt(stacked, keys).groupBy(*keys).agg(
        *[F.first(F.when(F.col("_side") == i, F.col("_row")), ignorenulls=True).alias(f"_{n}") for i, n in enumerate(names)],
        *[F.count_if(F.col("_side") == i).alias(f"_n_{n}") for i, n in enumerate(names)],
    )

    def unique(name: str) -> Column:
        message = F.concat(F.lit(f"repeated key in {name}: "), _key_text(keys))
        return F.when(F.col(f"_n_{name}") > 1, F.raise_error(message).cast(found.schema[f"_{name}"].dataType)).otherwise(F.col(f"_{name}"))

    return found.select(*keys, *[unique(n).alias(n) for n in names])


def _fields(df: DataFrame, side: str) -> list[str]:
    return df.schema[side].dataType.fieldNames()


def _same(left: Column, right: Column, fields: Sequence[str]) -> Column:
    """Both absent, or both present with null-safe equal fields."""
    equal = reduce(Column.__and__, [left[f].eqNullSafe(right[f]) for f in fields], F.lit(True))
    return (left.isNull() == right.isNull()) & equal


def _differing(left: Column, right: Column, fields: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~left[f].eqNullSafe(right[f]), F.lit(f)) for f in sorted(fields)]))


def _paired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column, Column, list[str]]:
    pairs = align(keys, left=left, right=right)
    return pairs, F.col("left"), F.col("right"), _fields(pairs, "left")


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], keep_same: bool = True) -> DataFrame:
    """Per key: `added`, `removed`, `changed` or `same`. Only keys and two 64-bit hashes per row are shuffled."""
    stacked = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    hashed = stacked.select(*keys, "_side", *[h.alias(f"_h{j}") for j, h in enumerate(row_hashes(stacked, [*keys, "_side"]))])
    own = lambda i, c: F.sum(F.when(F.col("_side") == i, F.col(c).cast("decimal(20,0)")))
    found = hashed.groupBy(*keys).agg(
        F.count_if(F.col("_side") == 0).alias("_n0"), F.count_if(F.col("_side") == 1).alias("_n1"), *[own(i, f"_h{j}").alias(f"_{i}{j}") for i in (0, 1) for j in (0, 1)]
    )
    same = (F.col("_00") == F.col("_10")) & (F.col("_01") == F.col("_11"))
    kind = F.when(F.col("_n0") == 0, "added").when(F.col("_n1") == 0, "removed").when(same, "same").otherwise("changed")
    for i, name in enumerate(("left", "right")):
        kind = F.when(F.col(f"_n{i}") > 1, F.raise_error(F.concat(F.lit(f"repeated key in {name}: "), _key_text(keys))).cast("string")).otherwise(kind)
    result = found.select(*keys, kind.alias("kind"))
    return result if keep_same else result.filter(F.col("kind") != "same")


def changed_fields(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key present on both sides with a difference: the sorted names of differing columns."""
    pairs, before, after, fields = _paired(left, right, keys)
    both = pairs.filter(before.isNotNull() & after.isNotNull())
    return both.select(*keys, _differing(before, after, fields).alias("fields")).filter(F.size("fields") > 0)


def change_set(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The differences with the new values: keys, kind, fields, new columns (null when removed)."""
    pairs, before, after, fields = _paired(left, right, keys)
    kind = F.when(before.isNull(), "added").when(after.isNull(), "removed").otherwise("changed")
    changed = F.when(kind == "changed", _differing(before, after, fields)).otherwise(F.array().cast("array<string>"))
    return pairs.filter(~_same(before, after, fields)).select(
        *keys, kind.alias("kind"), changed.alias("fields"), *[after[f].alias(f) for f in fields]
    )


def apply_diff(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base plus a change set gives the target table."""
    untouched = base.join(large(changes.select(*keys), keys), list(keys), "left_anti")
    written = changes.filter(F.col("kind") != "removed").select(*base.columns)
    return untouched.select(*base.columns).unionByName(written)


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three-way merge, one row per key of any side.

    `status` is `clean`, `deleted` or `conflict`; `kind` names the conflict (`modify_delete`,
    `field`, `add_add`), `fields` its columns; `merged` is the clean result. The three versions
    stay in the columns `base`, `ours`, `theirs` for reports and for `resolve`.
    """
    sides = align(keys, base=base, ours=ours, theirs=theirs)
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    fields = _fields(sides, "base")
    agree, ours_kept, theirs_kept = _same(o, t, fields), _same(b, o, fields), _same(b, t, fields)
    all_there = b.isNotNull() & o.isNotNull() & t.isNotNull()
    clashing = F.array_compact(
        F.array(
            *[
                F.when(~o[f].eqNullSafe(t[f]) & ~o[f].eqNullSafe(b[f]) & ~t[f].eqNullSafe(b[f]), F.lit(f))
                for f in sorted(fields)
            ]
        )
    )
    by_column = F.struct(*[F.when(o[f].eqNullSafe(b[f]), t[f]).otherwise(o[f]).alias(f) for f in fields])
    settled = agree | ours_kept | theirs_kept
    kind = (
        F.when(settled, None)
        .when(all_there & (F.size(clashing) > 0), "field")
        .when(b.isNull(), "add_add")
        .when(o.isNull() | t.isNull(), "modify_delete")
    )
    names = (
        F.when(kind == "field", clashing)
        .when(kind == "add_add", _differing(o, t, fields))
        .otherwise(F.array().cast("array<string>"))
    )
    merged = F.when(agree | theirs_kept, o).when(ours_kept, t).when(all_there & (F.size(clashing) == 0), by_column)
    planned = sides.select(*keys, "base", "ours", "theirs", kind.alias("kind"), names.alias("fields"), merged.alias("merged"))
    status = F.when(F.col("kind").isNotNull(), "conflict").when(F.col("merged").isNull(), "deleted").otherwise("clean")
    return planned.withColumn("status", status)


def merged_rows(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The clean rows of a merge as a flat table."""
    return merged.filter(F.col("status") == "clean").select(*keys, "merged.*")


def conflicts(merged: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Conflict records: object_id, kind, base/ours/theirs as JSON, fields, message."""
    key = F.concat_ws(".", *[F.col(f"`{k}`").cast("string") for k in keys])
    where = F.when(F.size("fields") > 0, F.concat(F.lit(" in "), F.array_join("fields", ", "))).otherwise(F.lit(""))
    return merged.filter(F.col("status") == "conflict").select(
        F.concat(F.lit(f"row:{table}."), key).alias("object_id"),
        "kind",
        *[F.when(F.col(side).isNotNull(), F.to_json(side)).alias(side) for side in ("base", "ours", "theirs")],
        "fields",
        F.concat(F.col("kind"), F.lit(" conflict"), where).alias("message"),
    )


def resolve(merged: DataFrame, keys: Sequence[str], strategy: str | None = None) -> DataFrame:
    """Flat merged table under a strategy.

    `ours` or `theirs` takes that side for conflicting columns, or its row or deletion; without a
    strategy conflicting keys are left out.
    """
    if strategy is None:
        return merged_rows(merged, keys)
    if strategy not in ("ours", "theirs"):
        raise ValueError(f"unknown strategy {strategy!r}")
    fields = _fields(merged, "base")
    b, o, t, side = F.col("base"), F.col("ours"), F.col("theirs"), F.col(strategy)
    by_column = F.struct(
        *[
            F.when(F.array_contains("fields", f), side[f]).when(o[f].eqNullSafe(b[f]), t[f]).otherwise(o[f]).alias(f)
            for f in fields
        ]
    )
    chosen = F.when(F.col("kind") == "field", by_column).when(F.col("kind").isNotNull(), side).otherwise(F.col("merged"))
    return merged.select(*keys, chosen.alias("_row")).filter(F.col("_row").isNotNull()).select(*keys, "_row.*")
