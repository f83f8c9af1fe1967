"""Unambiguous row encoding and content ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def value_text(value: Column, dtype: T.DataType) -> Column:
    """Exact text of a non-null value; equal values give equal texts.

    Doubles use the shortest text that reads back to the same number (and -0.0 counts as
    0.0), timestamps with zone their UTC microseconds.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (value + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: encode(item, dtype.elementType))
        return F.concat(F.size(value).cast("string"), F.lit("["), F.array_join(items, ""), F.lit("]"))
    if isinstance(dtype, T.MapType):
        entry = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        encoded = F.transform(F.map_entries(value), lambda item: encode(item, entry))
        return F.array_join(F.array_sort(encoded), "")
    if isinstance(dtype, T.StructType):
        return F.concat(*[encode(value[f.name], f.dataType) for f in dtype.fields])
    return value.cast("string")


def _parts(value: Column, dtype: T.DataType) -> list[Column]:
    """Pieces of one encoded value, to be concatenated.

    Numbers, times and flags end with `;` and can hold none; other values carry their length in
    front. Null is `N;` or `N:`, which no number or length looks like.
    """
    text = value_text(value, dtype)
    if isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [F.coalesce(text, F.lit("N")), F.lit(";")]
    return [F.coalesce(F.octet_length(text).cast("string"), F.lit("N")), F.lit(":"), F.coalesce(text, F.lit(""))]


def encode(value: Column, dtype: T.DataType) -> Column:
    """Encoding of one value; neighbouring values can never run together."""
    return F.concat(*_parts(value, dtype))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Encoding of the named columns (all by default), in the given order."""
    names = list(columns or df.columns)
    return F.concat(F.lit(""), *[part for n in names for part in _parts(F.col(f"`{n}`"), df.schema[n].dataType)])


def content_id(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 hex of the row encoding."""
    return F.sha2(row_text(df, columns), 256)


def empty_as_absent(df: DataFrame, optional: Sequence[str], required_lists: Sequence[str] = ()) -> DataFrame:
    """Make null, '', false and [] of optional fields one value (null); required lists null -> []."""
    replaced = {}
    for name in optional:
        dtype, value = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(dtype, T.StringType):
            replaced[name] = F.nullif(value, F.lit(""))
        elif isinstance(dtype, T.BooleanType):
            replaced[name] = F.when(value, value)
        elif isinstance(dtype, T.ArrayType):
            replaced[name] = F.when(F.size(value) > 0, value)
    for name in required_lists:
        replaced[name] = F.coalesce(F.col(f"`{name}`"), F.array().cast(df.schema[name].dataType))
    return df.withColumns(replaced)


def packed(text: Column) -> Column:
    """A text in half the bytes if it is even, lower-case hex, as hashes are; any other text as it is. A first byte tells which."""
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(value: Column) -> Column:
    """The text of a packed one."""
    rest = F.substring(value, 2, 2**31 - 1)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
