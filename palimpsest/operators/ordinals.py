"""Dense ordinals and generated names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.groups import in_order, rank_in_group


def densify(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "ordinal", limit: int | None = None) -> DataFrame:
    """Replace gapped ordinals by 1..n in the given order."""
    return rank_in_group(df.drop(out), group, order, out, limit)


def default_names(
    df: DataFrame, group: Sequence[str], name: str, stem: str, order: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Give members without a name `stem`, `stem1`, `stem2`, … skipping all names taken in the group.

    Explicit names count first, whatever their member's stem; then nameless members take the first free name in order, so
    names are unique in a group unless given twice. Stems can only clash if they differ in digits at their end. Where a
    group has one such stem, the r-th nameless member takes the r-th free number: a taken number t with i-1 taken numbers
    below it has t-(i-1) free ones before it, and ranking free slots and taken numbers together gives each member its
    number directly. Where stems can clash, members go through one task in order, one at a time.
    """
    columns, digits = df.columns, F.lit("[0-9]+$")
    nameless = F.nullif(F.col(name), F.lit("")).isNull()
    placed = df.withColumn("_g", F.to_json(F.struct(*[F.col(f"`{c}`") for c in group])))  # null equals null
    named, asked = placed.filter(~nameless), placed.filter(nameless).withColumn("_c", F.regexp_replace(F.col(stem), digits, F.lit("")))
    stems = asked.groupBy("_g", "_c").agg(F.min(stem).alias("_low"), F.max(stem).alias("_high"))
    taken = named.select("_g", F.col(name).alias("_name"), F.regexp_replace(F.col(name), digits, F.lit("")).alias("_c")).distinct().join(stems, ["_g", "_c"])
    single = F.col("_low") == F.col("_high")
    alone = asked.join(stems.filter(single), ["_g", "_c"], "left_semi").drop("_c")
    clashing = asked.join(stems.filter(~single), ["_g", "_c"], "left_semi")
    filled = _by_rank(alone, taken.filter(single).select("_g", "_name", F.col("_low").alias(stem)), name, stem, order, limit)
    rest = _one_by_one(clashing, taken.filter(~single).select("_g", "_c", "_name"), name, stem, order)
    unstemmed = asked.filter(F.col(stem).isNull())
    return named.select(*columns).unionByName(filled.select(*columns)).unionByName(rest.select(*columns)).unionByName(unstemmed.select(*columns))


def _by_rank(asked: DataFrame, taken: DataFrame, name: str, stem: str, order: Sequence[str], limit: int | None) -> DataFrame:
    """Names of members whose stem clashes with no other."""
    keys = ["_g", stem]
    free = rank_in_group(asked, keys, order, "_r", limit)
    tail = F.expr(f"substring(_name, length(`{stem}`) + 1)")
    numbered = taken.filter(F.expr(f"startswith(_name, `{stem}`)") & tail.rlike(r"^([1-9][0-9]{0,17})?\z"))
    numbers = numbered.select(*keys, F.coalesce(F.nullif(tail, F.lit("")), F.lit("0")).cast("bigint").alias("_t")).distinct()
    slots = rank_in_group(numbers, keys, ["_t"], "_i", limit).select(
        *keys, (F.col("_t") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_mine"), F.col("_t").alias("_tie")
    )
    members = free.select(*keys, (F.col("_r") - 1).alias("_at"), F.lit(1).alias("_mine"), F.col("_r").alias("_tie"))
    placed = rank_in_group(slots.unionByName(members), keys, ["_at", "_mine", "_tie"], "_k", limit).filter("_mine = 1")
    found = placed.select(*keys, F.col("_tie").alias("_r"), (F.col("_k") - 1).alias("_number"))
    number = F.when(F.col("_number") == 0, F.lit("")).otherwise(F.col("_number").cast("string"))
    return free.join(found, [*keys, "_r"], "inner").withColumn(name, F.concat(F.col(stem), number))


def _one_by_one(asked: DataFrame, taken: DataFrame, name: str, stem: str, order: Sequence[str]) -> DataFrame:
    """Names of members whose stems clash: streamed in order, with the names of the family so far in memory."""
    columns = [c for c in asked.columns if c not in ("_g", "_c")]
    given = taken.select("_g", "_c", F.lit(0).alias("_kind"), F.col("_name"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in columns])
    rows = given.unionByName(asked.select("_g", "_c", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_name"), *columns))
    by = [F.col("_g"), F.col("_c"), F.col("_kind"), *in_order(asked, [*order, *[c for c in columns if c not in order]])]
    sorted_rows = rows.repartition(F.xxhash64("_g", "_c")).sortWithinPartitions(*by)
    schema = asked.select(*columns).schema
    at = columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, used, numbers = None, set(), {}
        for batch in batches:
            names = []
            for g, c, kind, own, base in zip(*[batch.column(x).to_pylist() for x in ("_g", "_c", "_kind", "_name", stem)]):
                if (g, c) != family:
                    family, used, numbers = (g, c), set(), {}
                if kind == 0:
                    used.add(own)
                    continue
                number = numbers.get(base, 0)
                while (found := f"{base}{number or ''}") in used:
                    number += 1
                used.add(found)
                numbers[base] = number + 1
                names.append(found)
            members = batch.filter(pa.compute.equal(batch.column("_kind"), 1)).select(columns)
            yield members.set_column(at, members.schema.field(at), pa.array(names, pa.string()))

    return sorted_rows.mapInArrow(run, schema)
