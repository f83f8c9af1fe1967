"""Versions of a keyed table, stored by key range with a hash tree over the ranges.

All versions of a table share the borders of its first one. A range is a folder of rows and a leaf of the tree: the
number of rows and two sums of row hashes, so the order of rows does not matter. A node above is made of its children.
Two versions are compared from the top down; rows are read, and shuffled, only from ranges whose leaves differ.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palimpsest.operators import versions
from palimpsest.operators.versions import row_hashes

RANGES = 1024  # of a table, at most; their borders are a list in each task
FAN = 32  # children of a node


def _borders(df: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """range, low: the smallest key of each of at most `ranges` ranges of about equal size."""
    spread = df.select(*keys).repartitionByRange(ranges, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("low"))
    lows = F.array_sort(F.collect_list("low"))
    return spread.agg(lows.alias("lows")).select(F.posexplode("lows").alias("range", "low"))


def _range_of(lows: list, kind: str, keys: Sequence[str]) -> Column:
    """The number of the range of a row: two short searches instead of a pass over all borders."""
    step = max(1, int(len(lows) ** 0.5))
    fields = kind.removeprefix("array<").removesuffix(">")
    quoted = F.struct(*[F.col(f"`{k}`") for k in keys])

    def literal(rows: list) -> Column:
        items = [F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, row)]) for row in rows]
        return F.array(*items).cast(f"array<{fields}>")

    def below(borders: Column, key: Column) -> Column:
        return F.size(F.filter(borders, lambda low: low <= key))

    coarse, fine = literal(lows[::step]), literal(lows)
    block = F.greatest(below(coarse, quoted) - 1, F.lit(0))
    inside = below(F.slice(fine, block * step + 1, F.lit(step)), quoted)
    return F.greatest(block * step + inside - 1, F.lit(0))


def write_version(df: DataFrame, keys: Sequence[str], folder: str, like: str | None = None, ranges: int = RANGES) -> None:
    """Writes a version: its rows by key range, the borders, and the hash tree. `like` is an earlier version's folder.

    Keys are of types that have literals (numbers, texts, dates, timestamps, booleans); null keys go to the first range.
    Keys below the first border, or new ones above the last, go to the first and last range.
    """
    spark = df.sparkSession
    borders = spark.read.parquet(f"{like}/borders") if like else _borders(df, keys, min(ranges, RANGES))
    rows = borders.orderBy("range").collect()  # at most RANGES
    borders = spark.createDataFrame(rows, borders.schema)
    borders.coalesce(1).write.parquet(f"{folder}/borders")
    number = _range_of([tuple(r["low"]) for r in rows], f"array<{borders.schema['low'].dataType.simpleString()}>", keys) if rows else F.lit(0)
    placed = df.withColumn("range", F.coalesce(number, F.lit(0)).cast("int"))
    spark.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{folder}/schema")  # a version may be empty
    placed.repartition("range").write.partitionBy("range").parquet(f"{folder}/rows")
    leaves = leaf_hashes(_rows(spark, folder))
    level, nodes, top = 0, leaves.select(F.lit(0).alias("level"), F.col("range").alias("node"), "n", "hash"), max(1, len(rows))
    tree = nodes
    while top > 1:
        level, top = level + 1, -(-top // FAN)
        children = F.array_sort(F.collect_list(F.struct("node", "n", "hash")))
        nodes = nodes.groupBy((F.col("node") / FAN).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.to_json(children), 256).alias("hash"))
        nodes = nodes.select(F.lit(level).alias("level"), "node", "n", "hash")
        tree = tree.unionByName(nodes)
    tree.coalesce(1).write.parquet(f"{folder}/tree")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{folder}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def leaf_hashes(rows: DataFrame) -> DataFrame:
    """range, n, hash of stored rows; one small row per range and task is shuffled."""
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in row_hashes(rows, ["range"])]
    return rows.groupBy("range").agg(F.count("*").alias("n"), F.concat_ws(":", *sums).alias("hash"))


def changed_ranges(spark: SparkSession, left: str, right: str) -> list[int]:
    """Ranges whose rows differ, found from the top of both trees down: below a node that is equal nothing is looked at."""
    first, second = (sorted(map(tuple, spark.read.parquet(f"{folder}/borders").collect())) for folder in (left, right))
    if first != second:
        raise ValueError("versions with different borders: write later ones like the first")
    trees = [spark.read.parquet(f"{folder}/tree").withColumnRenamed("hash", f"hash{i}").drop("n") for i, folder in enumerate((left, right))]
    level = max(t.agg(F.max("level")).first()[0] or 0 for t in trees)
    open_: list[int] | None = None
    while level >= 0:
        at = [t.where((F.col("level") == level) & (F.lit(True) if open_ is None else (F.col("node") / FAN).cast("int").isin(open_))) for t in trees]
        open_ = sorted(r["node"] for r in at[0].join(at[1], ["level", "node"], "full").where("not (hash0 <=> hash1)").collect())
        if not open_:
            return []
        level -= 1
    return open_


def read_version(spark: SparkSession, folder: str, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of a version, or of some of its ranges: the folders of all others are not opened."""
    rows = _rows(spark, folder)
    return (rows if only is None else rows.where(F.col("range").isin(list(only)))).drop("range")


def _differing(spark: SparkSession, keys: Sequence[str], *folders: str) -> list[DataFrame]:
    """The rows of the ranges in which any version differs from the first."""
    only = sorted({r for folder in folders[1:] for r in changed_ranges(spark, folders[0], folder)})
    return [read_version(spark, folder, only) for folder in folders]


def diff(spark: SparkSession, left: str, right: str, keys: Sequence[str]) -> DataFrame:
    """Keys that are `added`, `removed` or `changed` between two stored versions."""
    return versions.diff(*_differing(spark, keys, left, right), keys, keep_same=False)


def change_set(spark: SparkSession, left: str, right: str, keys: Sequence[str]) -> DataFrame:
    """`versions.change_set` of two stored versions."""
    return versions.change_set(*_differing(spark, keys, left, right), keys)


def changed_fields(spark: SparkSession, left: str, right: str, keys: Sequence[str]) -> DataFrame:
    """`versions.changed_fields` of two stored versions."""
    return versions.changed_fields(*_differing(spark, keys, left, right), keys)


def merge3(spark: SparkSession, base: str, ours: str, theirs: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(`versions.merge3` of the ranges that one side changed, rows of all other ranges, which are the base's and clean)."""
    changed = sorted({r for side in (ours, theirs) for r in changed_ranges(spark, base, side)})
    merged = versions.merge3(*[read_version(spark, folder, changed) for folder in (base, ours, theirs)], keys)
    rest = _rows(spark, base).where(~F.col("range").isin(changed) if changed else F.lit(True)).drop("range")
    return merged, rest
