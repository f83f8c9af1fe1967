"""Lists, documents, duplicates and matches per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.groups import lists_in_group
from palimpsest.session import dealt, durable, large


def ordered_list(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str, limit: int | None = None) -> DataFrame:
    """Values per group in order: keys, part, `name` (one part unless a `limit` is given)."""
    return lists_in_group(df.select(*dict.fromkeys([*keys, *order, value])), keys, F.col(value), order, name, limit)


def with_lists(parents: DataFrame, lists: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Attach lists to every parent; parents without members get [] as part 0."""
    empty = F.array().cast(lists.schema[name].dataType)
    joined = parents.join(large(lists, keys), list(keys), "left")
    return joined.withColumns({"part": F.coalesce("part", F.lit(0)), name: F.coalesce(F.col(name), empty)})


def distinct_sorted(df: DataFrame, keys: Sequence[str], value: str, name: str, limit: int | None = None) -> DataFrame:
    """Distinct non-null values per group, ascending."""
    once = durable(df.select(*keys, value).filter(F.col(value).isNotNull()).distinct())  # counted and gathered
    return lists_in_group(once, keys, F.col(value), [value], name, limit)


def distinct_first_seen(df: DataFrame, keys: Sequence[str], value: str, position: str, name: str, limit: int | None = None) -> DataFrame:
    """Distinct values per group in order of first appearance."""
    first = df.groupBy(*keys, value).agg(F.min(position).alias("_seen"))
    return lists_in_group(first, keys, F.col(value), ["_seen", value], name, limit)


def duplicates(df: DataFrame, keys: Sequence[str], count: str = "times") -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def count_where(df: DataFrame, keys: Sequence[str], predicate: Column, most: int, count: str = "matches") -> DataFrame:
    """Groups in which more than `most` rows satisfy the predicate."""
    return df.groupBy(*keys).agg(F.count_if(predicate).alias(count)).filter(F.col(count) > most)


def unique_match(df: DataFrame, keys: Sequence[str], match: str, out: str = "match") -> DataFrame:
    """Per key `ok` with its only distinct match, `ambiguous`, or `unknown` when nothing matched.

    Minimum and maximum tell one match from several without collecting or counting them.
    """
    low, high = F.min(match), F.max(match)
    found = df.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
    status = F.when(F.col("_low").isNull(), "unknown").when(F.col("_low") == F.col("_high"), "ok").otherwise("ambiguous")
    return found.select(*keys, F.when(status == "ok", F.col("_low")).alias(out), status.alias("status"))


def nest(parents: DataFrame, keys: Sequence[str], limit: int | None = None, **members: tuple[DataFrame, Column, Sequence[str]]) -> DataFrame:
    """Parents with one list column per member relation, members in the order of their id.

    Each member is (relation with the parent keys, element, order columns). All lists of one
    parent and part (0 alone without a `limit`) stand in one row; parents with no members keep one row with empty lists.
    """
    whole = parents.select(*keys, F.lit(0).cast("bigint").alias("part"))
    lists = {
        name: lists_in_group(rows, keys, element, order, name, limit) for name, (rows, element, order) in members.items()
    }
    slots, by = whole, list(keys)
    if limit:
        by.append("part")
        for found in lists.values():
            slots = slots.unionByName(found.filter(F.col("part") > 0).select(*keys, "part"))
    nested = dealt(slots, by).distinct()
    for name, found in lists.items():
        empty = F.array().cast(found.schema[name].dataType)
        members = found.select(*by, name)
        nested = nested.join(large(members, by), by, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return parents.join(nested.hint("merge"), list(keys), "inner")
