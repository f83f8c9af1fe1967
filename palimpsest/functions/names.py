"""Object ids, hashes, refs and file-safe names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Id prefix per object kind.
KIND_PREFIX = {
    "namespace": "ns",
    "table": "tbl",
    "column": "col",
    "constraint": "con",
    "index": "idx",
    "view": "view",
    "enum": "enum",
    "sequence": "seq",
    "function": "fn",
}


def default_namespace(name: Column) -> Column:
    """Missing or empty namespace means `public`."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("public"))


def object_id(kind: str, namespace: Column, name: Column | None = None, member: Column | None = None) -> Column:
    """Stable `prefix:namespace.name[.member]` id."""
    parts = [default_namespace(namespace), *[p for p in (name, member) if p is not None]]
    return F.concat(F.lit(KIND_PREFIX[kind] + ":"), F.concat_ws(".", *parts))


def is_hash(value: Column) -> Column:
    """Exactly 64 lowercase hex digits; null is not a hash."""
    return F.coalesce(value.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_ref(value: Column) -> Column:
    """A clean `refs/heads/…` or `refs/tags/…` path."""
    shaped = value.rlike(r"^refs/(heads|tags)(/[^/]+)+\z")
    unclean = value.contains("\\") | value.contains("..") | value.rlike(r"/\.(/|\z)")
    return F.coalesce(shaped & ~unclean, F.lit(False))


def unqualify(value: Column) -> Column:
    """Last dotted component of a possibly quoted name."""
    bare = F.regexp_replace(value, r'^[\s"]+|[\s"]+$', "")
    return F.substring_index(bare, ".", -1)


def safe_name(value: Column) -> Column:
    """File-safe form of an object id; different ids can share one (see `name_collisions`)."""
    cleaned = F.regexp_replace(value, r"[:/\\ ]|\.\.", "_")
    return F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned)
