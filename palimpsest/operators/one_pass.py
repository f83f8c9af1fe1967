"""Many rules on one table in one pass: one scan, and one grouping keyed by rule.

Each row is expanded into the row rules it breaks and the keys it has; a key shared by two rows breaks its rule. Rows
that break nothing and have no key rule leave nothing behind. References to other tables need a join each and stay with
`constraints`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F


@dataclass(frozen=True)
class RowRule:
    """A row breaks `name` in `field` where `broken` is true (null passes)."""

    name: str
    field: str
    broken: Column
    detail: Column | str = ""


@dataclass(frozen=True)
class KeyRule:
    """`columns` are unique among the rows that satisfy `where`. A null part passes, or, for a primary key, breaks the rule."""

    name: str
    columns: tuple[str, ...]
    where: str | None = None
    primary: bool = False

    def null(self) -> Column:
        return reduce(Column.__or__, [F.col(f"`{c}`").isNull() for c in self.columns])

    def concerned(self) -> Column:
        return F.coalesce(F.expr(self.where), F.lit(False)) if self.where else F.lit(True)

    def key(self) -> Column:
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.columns]))


Rule = RowRule | KeyRule


def _row(rule: str, row: Column, field: str, detail: Column | str, key: Column) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(rule).alias("rule"), row.alias("object_id"), F.lit(field).alias("field"), text.cast("string").alias("detail"), key.alias("key"))


def check_all(df: DataFrame, object_id: Column, rules: Sequence[Rule], counts: Observation | None = None) -> DataFrame:
    """Violations of all rules: rule, object_id, field, detail, times.

    For a row rule, object_id names the row and `times` counts equal violations of it. For a key rule object_id is the key
    as JSON, detail is `repeated key` and `times` its rows; a null part of a primary key is `null key` of the row. `counts`
    gets the number of rows, and of rows that break each row rule (by its position: r0, r1, …), when the result is computed.
    Names of rules should differ.
    """
    ident, none = object_id.cast("string"), F.lit(None).cast("string")
    items = []
    for rule in rules:
        if isinstance(rule, RowRule):
            items.append(F.when(rule.broken, _row(rule.name, ident, rule.field, rule.detail, none)))
            continue
        fields = ",".join(rule.columns)
        items.append(F.when(rule.concerned() & ~rule.null(), _row(rule.name, none, fields, "repeated key", rule.key())))
        if rule.primary:
            items.append(F.when(rule.concerned() & rule.null(), _row(rule.name, ident, fields, "null key", none)))
    if counts is not None:
        broken = [F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules) if isinstance(r, RowRule)]
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"), *broken)
    expanded = df.select(F.explode(F.array_compact(F.array(*items))).alias("x")).select("x.*")
    grouped = expanded.groupBy("rule", "object_id", "field", "detail", "key").agg(F.count(F.lit(1)).alias("times"))
    kept = grouped.where("key is null or times > 1")
    return kept.select("rule", F.coalesce("object_id", "key").alias("object_id"), "field", "detail", "times")
