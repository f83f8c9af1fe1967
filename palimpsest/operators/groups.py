"""Ranks and lists inside groups of any size.

A plain window or `collect_list` puts a whole group into one task. These helpers first count
the rows per group (a map-side combined aggregate on the keys alone). Groups up to
`HOT_GROUP_ROWS` take the plain way; larger ones are spread over many tasks by a range
partitioning on (keys, order). Results are the same both ways; lists come back in numbered parts
only where a limit is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.session import dealt, durable

HOT_GROUP_ROWS = 100_000


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys that may be null (null equals null)."""
    same = [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys]
    return left.join(right, reduce(Column.__and__, same), how)


def in_order(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns to sort by; values that have no order (maps, variants) go by their JSON text."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    loose = lambda c: "map<" in kinds[c] or "variant" in kinds[c]
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if loose(c) else F.col(f"`{c}`") for c in names]


def split_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to `limit` rows, and rows of larger groups (None when there are none)."""
    limit = limit or HOT_GROUP_ROWS
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # At most rows/limit keys: small beside the data, and Spark picks the join by its size.
    hot = durable(sizes.filter(F.col("_rows") > limit).select(*keys))
    if hot.isEmpty():
        return df, None
    renamed = hot.select(*[F.col(f"`{k}`").alias(k) for k in keys])
    return on_keys(df, renamed, keys, "left_anti"), on_keys(df, renamed, keys, "left_semi")


def _spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, block: int) -> DataFrame:
    """1-based rank of every row by `order` in its group, without one task per group.

    Equal rows are combined first, so a group of copies is one row with a count. Range
    partitions are ranked on their own and shifted by the rows of the same group in earlier
    partitions; only groups that cross a partition border need a shift, at most two rows per
    border, so the shift table is safe to broadcast.
    """
    spark = df.sparkSession
    columns = df.columns
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in columns if c not in keys and c not in order]
    by = in_order(df, [*keys, *order, *rest])
    combined = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    spread = durable(combined.repartitionByRange(tasks, *by).withColumn("_task", F.spark_partition_id()))

    per_task = spread.groupBy(*keys, "_task").agg(F.sum("_copies").alias("_rows"))
    group = W.partitionBy(*keys)  # at most one row per task in a group
    earlier = group.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        per_task.withColumns({"_spans": F.count(F.lit(1)).over(group), "_shift": F.sum("_rows").over(earlier)})
        .filter("_spans > 1 and _shift is not null")
        .select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys], F.col("_task").alias("_s_task"), "_shift")
    )
    window = W.partitionBy(*keys, "_task").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    local = spread.withColumn("_before", F.coalesce(F.sum("_copies").over(window), F.lit(0)))
    same = [local[f"`{k}`"].eqNullSafe(shifts[f"`_k_{k}`"]) for k in keys]
    same.append(local["_task"] == shifts["_s_task"])
    placed = local.join(F.broadcast(shifts), reduce(Column.__and__, same), "left").select(
        *columns, (F.col("_before") + F.coalesce("_shift", F.lit(0))).alias("_first"), "_copies"
    )
    # Copies come back in blocks, so a row with very many copies is unfolded by many tasks.
    blocks = placed.select(
        *columns,
        "_first",
        "_copies",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / block))).alias("_block"),
    )
    sized = blocks.select(
        *columns,
        (F.col("_first") + F.col("_block") * block).alias("_from"),
        F.least(F.lit(block), F.col("_copies") - F.col("_block") * block).alias("_size"),
    ).repartition(tasks, "_from")
    return sized.select(*columns, F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + F.col("_size"))).alias(name))


def rank_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", limit: int | None = None
) -> DataFrame:
    """Add the dense 1-based position by ascending `order` (null first) in each group; ties go by the other columns.

    With no keys the whole table is one group and always takes the spread way.
    """
    limit = limit or HOT_GROUP_ROWS
    if not keys:
        return _spread_rank(df, keys, order, name, limit)
    cold, hot = split_hot(df, keys, limit)
    rest = [c for c in df.columns if c not in keys and c not in order]
    window = W.partitionBy(*keys).orderBy(*in_order(df, [*order, *rest]))
    ranked = dealt(cold, keys).withColumn(name, F.row_number().over(window).cast("bigint"))
    return ranked if hot is None else ranked.unionByName(_spread_rank(hot, keys, order, name, limit))


def lists_in_group(
    df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[str], name: str, limit: int | None = None
) -> DataFrame:
    """Values of each group as a list in ascending `order`, ties by value: keys, part, `name`.

    A group of any size is one row with part 0. Only an explicit `limit` cuts lists into parts 0, 1, …
    of at most `limit` values each, so no value of the list has to pass through a single task or cell.
    """
    block = limit or HOT_GROUP_ROWS
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *order])], value.alias("_v"))

    def gather(rows: DataFrame, by: Sequence[str], sort: Sequence[str]) -> DataFrame:
        item = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(sort)], F.col("_v").alias("v"))
        sorted_items = F.array_sort(F.collect_list(item))
        # Lists are not shorter when begun before the shuffle: a task that reads many groups would hold them all.
        return dealt(rows, by).groupBy(*by).agg(F.transform(sorted_items, lambda x: x["v"]).alias(name))

    cold, hot = split_hot(df, keys, block)
    part = F.lit(0).cast("bigint").alias("part")
    plain = gather(cold, keys, order).select(*keys, part, name)
    if hot is None:
        return plain
    ranked = _spread_rank(hot, keys, order, "_rank", block)
    parts = gather(ranked.withColumn("part", F.floor((F.col("_rank") - 1) / block)), [*keys, "part"], ["_rank"])
    if not limit:  # sorted by many tasks, put together at last
        sorted_parts = F.array_sort(F.collect_list(F.struct("part", F.col(name).alias("l"))))
        parts = parts.groupBy(*keys).agg(F.flatten(F.transform(sorted_parts, lambda x: x["l"])).alias(name)).withColumn("part", part)
    return plain.unionByName(parts.select(*keys, "part", name))
