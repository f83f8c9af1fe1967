"""Risk labels, gates, schema comparison and the state of migrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.described_types import type_base
from palimpsest.functions.encoding import empty_as_absent
from palimpsest.operators.versions import change_set
from palimpsest.session import large


def classify_risk(changes: DataFrame, narrowing: Column | None = None) -> DataFrame:
    """Add `risk`: removals and narrowing changes are `destructive`, the rest `safe`."""
    destructive = F.col("kind") == "removed"
    if narrowing is not None:
        destructive = destructive | F.coalesce(narrowing, F.lit(False))
    return changes.withColumn("risk", F.when(destructive, "destructive").otherwise("safe"))


def gate(changes: DataFrame, scope: Sequence[str] = (), block: bool | None = None) -> DataFrame:
    """Pass changes through unless their scope has a destructive one.

    `block` unset means block. Without a scope one destructive change empties the result; with a
    scope (such as a repository) only its own changes are held back.
    """
    if block is False:
        return changes
    bad = changes.filter(F.col("risk") == "destructive")
    if scope:
        return changes.join(large(bad.select(*scope).distinct(), scope), list(scope), "left_anti")
    return changes.where(~bad.exists())


def schema_diff(left: DataFrame, right: DataFrame, key: str, optional: Sequence[str] = ()) -> DataFrame:
    """Changes between two catalogs keyed by object id; empty optional fields count as absent."""
    return change_set(empty_as_absent(left, optional), empty_as_absent(right, optional), [key])


# Fixed values: (from, to) base types where every value of the first is one of the second.
WIDER = (
    ("int2", "int4"), ("int2", "int8"), ("int4", "int8"), ("float4", "float8"),
    ("int2", "numeric"), ("int4", "numeric"), ("int8", "numeric"),
    ("int2", "float4"), ("int2", "float8"), ("int4", "float8"),
    ("varchar", "text"), ("text", "varchar"), ("bpchar", "text"), ("bpchar", "varchar"), ("date", "timestamp"), ("bit", "varbit"),
)
# Decimal digits before the point that a base type may need.
DIGITS = {"int2": 5, "int4": 10, "int8": 19}


def narrows(before: Column, after: Column) -> Column:
    """Does a type change lose room, so that some value of the old type is none of the new one.

    Bases must be equal or a pair of `WIDER`. Numbers keep their digits before and after the point, texts and bits their
    length, times their fraction; a type without modifiers has no bound (one character for bpchar and bit). Arrays compare by their elements, and an array is
    never an element.
    """
    old, new = type_base(before), type_base(after)
    pair = F.concat_ws(">", old, new)
    widened = (old == new) | pair.isin(*[f"{a}>{b}" for a, b in WIDER])
    inner = lambda c: F.regexp_extract(c, r"\(([^)]*)\)", 1)
    part = lambda c, i: F.get(F.split(inner(c), r"\s*,\s*"), F.lit(i)).try_cast("int")
    arrays = lambda c: F.regexp_count(c, F.lit(r"\[\]")) > 0

    def length(c: Column, base: Column) -> Column:
        return F.coalesce(part(c, 0), F.when(base.isin("bpchar", "bit"), F.lit(1)))

    whole = lambda c: part(c, 0) - F.coalesce(part(c, 1), F.lit(0))
    needed = F.when(old == "numeric", whole(before)).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for item in DIGITS.items() for x in item]), old))
    bounded = part(after, 0).isNotNull()
    number = bounded & (needed.isNull() | (whole(after) < needed) | (F.when(old == "numeric", F.coalesce(part(before, 1), F.lit(0))).otherwise(F.lit(0)) > F.coalesce(part(after, 1), F.lit(0))))
    long = length(after, new).isNotNull() & (length(before, old).isNull() | (length(after, new) < length(before, old)))
    texts = new.isin("varchar", "bpchar", "bit", "varbit")
    other = bounded & (F.coalesce(part(before, 0), F.lit(6)) > part(after, 0))  # fractions of a second: six digits unless said
    tighter = F.when(new == "numeric", number).when(texts, long).otherwise(other)
    return ~widened | (arrays(before) != arrays(after)) | F.coalesce(tighter, F.lit(False))


def pending(stored: DataFrame, applied: DataFrame, key: str = "migration_id") -> DataFrame:
    """Stored but not applied (`pending`) and applied but not stored (`unknown`), in one pass."""
    both = stored.select(key).distinct().withColumn("_s", F.lit(True)).join(
        applied.select(key).distinct().withColumn("_a", F.lit(True)), key, "full"
    )
    state = F.when(F.col("_a").isNull(), "pending").when(F.col("_s").isNull(), "unknown")
    return both.select(key, state.alias("state")).filter("state is not null")


def tampered(migrations: DataFrame) -> DataFrame:
    """Migrations whose up text no longer gives the stored checksum; a missing text or checksum counts as well."""
    actual = F.sha2("up_sql", 256)
    return migrations.select("migration_id", "checksum", actual.alias("actual")).filter("not (checksum <=> actual)")
