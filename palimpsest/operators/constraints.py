"""Declared constraints checked against data rows; every check returns its violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators.aggregates import duplicates
from palimpsest.operators.groups import rank_in_group
from palimpsest.operators.relational import not_backed_by
from palimpsest.session import durable


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{c}`").isNull() for c in columns])


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of nulls per column that has any: field, violations."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("violations")) for c in columns]))
    return counts.select(pairs.alias("p")).select("p.*").filter("violations > 0")


def check_unique(df: DataFrame, columns: Sequence[str], nulls_distinct: bool = True) -> DataFrame:
    """Keys that occur more than once; a key with a null part never clashes."""
    if not nulls_distinct:
        raise ValueError("only distinct nulls are supported")
    return duplicates(df.filter(~_any_null(columns)), columns)


def check_pk(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that are null in a part or occur more than once: columns, rule, times."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    rule = F.when(_any_null(columns), "null key").when(F.col("times") > 1, "repeated key")
    return counted.withColumn("rule", rule).filter(F.col("rule").isNotNull())


def check_partial_unique(df: DataFrame, columns: Sequence[str], predicate: str) -> DataFrame:
    """Uniqueness among the rows that satisfy the predicate."""
    return check_unique(df.filter(F.expr(predicate)), columns)


def check_expr(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is false; null passes."""
    return df.filter(~F.expr(expression))


def check_generated(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Rows whose stored value is not the value of the expression; both are shown."""
    return df.withColumn("expected", F.expr(expression)).filter(~F.col(column).eqNullSafe(F.col("expected")))


def check_fk(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows whose key is complete but not in the parent; any null part passes."""
    if not columns or len(columns) != len(parent_columns):
        raise ValueError("column lists must be non-empty and of equal length")
    keys = parent.select(*[F.col(f"`{p}`").alias(f"_parent{i}") for i, p in enumerate(parent_columns)])
    complete = child.filter(~_any_null(columns))
    return not_backed_by(complete, keys, [(c, f"_parent{i}") for i, c in enumerate(columns)])


def check_enum(df: DataFrame, column: str, values: DataFrame | Sequence[str]) -> DataFrame:
    """Rows whose value is not a label of the enum; null passes."""
    if isinstance(values, DataFrame):
        labels = values.select(F.col(values.columns[0]).alias("_label"))
        return not_backed_by(df.filter(F.col(column).isNotNull()), labels, [(column, "_label")])
    return df.filter(~F.col(column).isin(*values))


def check_bounds(df: DataFrame, column: str, start: int, increment: int, min_value: int, max_value: int) -> DataFrame:
    """Values outside min..max or off the grid start + n * increment: adds `rule`."""
    value = F.col(column)
    rule = F.when(~value.between(min_value, max_value), "out of bounds").when((value - start) % increment != 0, "off grid")
    return df.withColumn("rule", rule).filter(F.col("rule").isNotNull())


def sequence_gaps(df: DataFrame, column: str, increment: int = 1, limit: int | None = None, start: int | None = None) -> DataFrame:
    """Runs of missing numbers between the smallest and largest value: gap_start, gap_end, missing.

    The grid is start + n * increment; without a `start` it begins at the smallest value. Values off the grid are left to
    `check_bounds`. A run starts after a value without a successor and ends before one without a predecessor. The
    n-th start belongs to the n-th end, so only the edges of runs are ranked, over many tasks.
    """
    given = df.select(F.col(column).alias("v")).filter("v is not null")
    origin = given.agg(F.min("v")).scalar() if start is None else F.lit(start)
    values = given.filter((F.col("v") - origin) % increment == 0).distinct()
    before = values.select((F.col("v") - increment).alias("w"))
    after = values.select((F.col("v") + increment).alias("w"))
    starts = values.join(before, F.col("v") == F.col("w"), "left_anti")
    ends = values.join(after, F.col("v") == F.col("w"), "left_anti")
    # The largest value starts no gap and the smallest ends none; ranks are shifted to pair them.
    left = rank_in_group(starts, [], ["v"], "n", limit).select("n", (F.col("v") + increment).alias("gap_start"))
    right = rank_in_group(ends, [], ["v"], "n", limit).select((F.col("n") - 1).alias("n"), (F.col("v") - increment).alias("gap_end"))
    runs = left.join(right, "n", "inner")
    return runs.select("gap_start", "gap_end", F.expr(f"(gap_end - gap_start) div {increment} + 1").alias("missing"))


def gaps_by_sequence(df: DataFrame, key: str, column: str, sequences: DataFrame) -> DataFrame:
    """Missing numbers of many sequences at once: key, gap_start, gap_end, missing.

    `sequences` has one row per key: start, increment (not 0), min_value, max_value. Values off a sequence's grid, or out
    of its bounds, or of a key without a sequence, are left to `check_bounds`. Gaps lie between the smallest and largest
    value of a key. Values are range-partitioned by (key, value), so a key of any size takes many tasks; a task's last
    value of a key finds its successor in a table of one row per key and task.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rule = sequences.select(F.col(key).alias("k"), "start", "increment", "min_value", "max_value")
    values = df.select(F.col(key).alias("k"), F.col(column).cast("bigint").alias("v")).join(rule, "k")
    values = values.where(F.col("v").between(F.col("min_value"), F.col("max_value")) & ((F.col("v") - F.col("start")) % F.col("increment") == 0))
    spread = durable(values.select("k", "v", F.abs("increment").alias("step")).distinct().repartitionByRange(tasks, "k", "v").withColumn("task", F.spark_partition_id()))
    ends = spread.groupBy("k", "task").agg(F.min("v").alias("first"))
    ahead = ends.select("k", "task", F.lead("first").over(Window.partitionBy("k").orderBy("task")).alias("beyond"))
    inside = F.lead("v").over(Window.partitionBy("k", "task").orderBy("v"))
    paired = spread.withColumn("next", inside).join(ahead, ["k", "task"]).withColumn("next", F.coalesce("next", "beyond"))
    gaps = paired.where(F.col("next") - F.col("v") > F.col("step"))
    begin, end = F.col("v") + F.col("step"), F.col("next") - F.col("step")
    return gaps.select(F.col("k").alias(key), begin.alias("gap_start"), end.alias("gap_end"), (F.expr("(next - v) div step") - 1).alias("missing"))
