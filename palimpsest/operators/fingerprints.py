"""Content fingerprints of tables and groups that do not depend on row order.

Each row is hashed with SHA-256. The hashes of a bucket are added up lane by lane (nine lanes of
20 bits, room for 2^43 rows per bucket, beyond which the sum fails rather than wraps). That is
exact, counts duplicates, needs no sort and combines before the shuffle: what travels is one small
row per bucket and task, whatever the table size. The root hashes the column names and the bucket
digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.encoding import content_id

WORDS, WORD_DIGITS = 3, 15
LANE_BITS, LANES = 20, 9


def _words(row_hash: str) -> list[Column]:
    """The first 180 bits of the hash as three numbers, read once per row."""
    return [
        F.conv(F.substring(row_hash, 1 + WORD_DIGITS * i, WORD_DIGITS), 16, 10).cast("bigint").alias(f"_word{i}") for i in range(WORDS)
    ]


def _lane_sums() -> list[Column]:
    mask = (1 << LANE_BITS) - 1
    sums = []
    for lane in range(LANES):
        word, place = divmod(lane, LANES // WORDS)
        shift = LANE_BITS * (LANES // WORDS - 1 - place)
        sums.append(F.sum(F.shiftright(f"_word{word}", shift).bitwiseAND(F.lit(mask))).alias(f"_lane{lane}"))
    return sums


def _digest(count: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(count).cast("string"), *[F.col(f"_lane{i}").cast("string") for i in range(LANES)]), 256)


def bucket_hashes(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Row count and digest per bucket; 16**digits buckets by row hash, or by key hash with `keys`.

    Comparing the buckets of two tables shows where they differ.
    """
    hashed = df.select(
        content_id(df, columns).alias("_row"),
        *([content_id(df, keys).alias("_key")] if keys else []),
    )
    return (
        hashed.select(F.substring("_key" if keys else "_row", 1, digits).alias("bucket"), *_words("_row"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("row_count"), *_lane_sums())
        .select("bucket", "row_count", _digest("row_count").alias("digest"))
    )


def table_hash(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """One row: row count and root hash. Equal exactly when names and rows (with repeats) are."""
    names = F.lit("|".join(f"{len(n)}:{n}" for n in columns or df.columns))
    buckets = bucket_hashes(df, columns, keys, digits)
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "digest")))  # at most 16**digits entries
    return buckets.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), ordered.alias("_buckets")).select(
        "row_count",
        F.sha2(F.concat(names, F.lit("\n"), F.array_join(F.transform("_buckets", lambda b: F.concat(b["bucket"], b["digest"])), "")), 256).alias(
            "root_hash"
        ),
    )


def group_hash(df: DataFrame, group: Sequence[str], columns: Sequence[str], prefix: str = "group") -> DataFrame:
    """Row count and content hash per group; groups with equal content have equal hashes."""
    hashed = df.select(*group, content_id(df, columns).alias("_row"))
    return (
        hashed.select(*group, *_words("_row"))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("row_count"), *_lane_sums())
        .select(*group, "row_count", _digest("row_count").alias(f"{prefix}_hash"))
    )
