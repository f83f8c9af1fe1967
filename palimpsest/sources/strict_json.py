"""Closed-world JSON: unknown keys, trailing content and broken documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def strict_json(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows that are not exactly one JSON object with allowed keys; adds `problem`, `unknown_keys`.

    A reader ignores what follows the object, so the text is read inside brackets and again as the value of a
    key: text that closes one wrapper early breaks the other.
    """
    inner = F.from_json(F.concat(F.lit('{"w":'), F.col(column), F.lit("}")), "map<string,string>")
    wrapped = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), "array<map<string,string>>")
    known = F.array(*[F.lit(k) for k in allowed])
    alone = inner.isNotNull() & (F.array_join(F.map_keys(inner), ",") == "w")
    whole = alone & wrapped.isNotNull() & (F.size(wrapped) == 1) & F.get(wrapped, F.lit(0)).isNotNull()
    unknown = F.array_sort(F.array_except(F.map_keys(F.get(wrapped, F.lit(0))), known))
    problem = F.when(~F.coalesce(whole, F.lit(False)), "malformed").when(F.size(unknown) > 0, "unknown keys")
    keys = F.when(problem == "unknown keys", unknown).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"problem": problem, "unknown_keys": keys}).filter("problem is not null")
