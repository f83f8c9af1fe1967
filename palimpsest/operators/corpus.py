"""Segmenting, grouping and cross-referencing many texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.names import object_id
from palimpsest.functions.texts import canonical_default, canonical_text, split_top_level, text_problem
from palimpsest.operators.aggregates import distinct_sorted, with_lists
from palimpsest.operators.relational import resolve_by_priority

# A name after a keyword that reads or writes a relation; the name may be quoted and dotted.
RELATION_NAME = r"""(?i)\b(?:from|join|update|into)\s+((?:"[^"]+"|[a-z_][a-z0-9_$]*)(?:\s*\.\s*(?:"[^"]+"|[a-z_][a-z0-9_$]*))*)"""


def segment(df: DataFrame, ids: Sequence[str], text: str, separator: str) -> DataFrame:
    """Trimmed non-empty pieces of each text with a dense ordinal: ids, ordinal, piece."""
    pieces = F.transform(F.split(F.col(text), separator, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    kept = F.filter(pieces, lambda p: p != "")
    return df.select(*ids, F.posexplode(kept).alias("_at", "piece")).select(*ids, (F.col("_at") + 1).alias("ordinal"), "piece")


def canonical_ids(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """Hash of the canonical form of each text: ids, text_hash."""
    return df.select(*ids, F.sha2(canonical_text(F.col(text)), 256).alias("text_hash"))


def broken_texts(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """Texts that open something and never close it: ids, problem. `canonical_ids` still gives them a hash of their own."""
    return df.select(*ids, text_problem(F.col(text)).alias("problem")).filter("problem is not null")


def canonical_groups(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Groups of texts with the same canonical form: text_hash, texts, first_id.

    Only hashes and ids are shuffled, combined on the map side; a group of any size is one row.
    """
    hashed = canonical_ids(df, [id_column], text)
    return hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("texts"), F.min(id_column).alias("first_id"))


def extract_references(df: DataFrame, ids: Sequence[str], text: str, pattern: str = RELATION_NAME) -> DataFrame:
    """Names found by the pattern's first group: ids, name, position of the first mention.

    Names are reduced to their last dotted part in lower case, each once per text.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    last = F.transform(found, lambda n: F.lower(F.replace(F.trim(F.regexp_extract(n, r"""("[^"]+"|[^."]+)\s*\z""", 1)), F.lit('"'), F.lit(""))))
    once = F.array_distinct(last)
    return df.select(*ids, F.posexplode(once).alias("position", "name"))


def extract_mentions(df: DataFrame, ids: Sequence[str], text: str, pattern: str) -> DataFrame:
    """Whole matches of the pattern's first group, each once per text in first-seen order."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    return df.select(*ids, F.posexplode(found).alias("position", "name"))


def view_references(views: DataFrame, namespace: str = "nspname", view: str = "relname", definition: str = "definition") -> DataFrame:
    """(namespace, view, view_id, name) for every relation a view reads."""
    named = views.withColumn("view_id", object_id("view", F.col(namespace), F.col(view)))
    edges = extract_references(
        named.withColumn("_text", canonical_text(F.col(definition))), [namespace, view, "view_id"], "_text"
    )
    return edges.drop("position")


def _candidates(namespace: str, name: str) -> Column:
    qualified = [object_id(kind, F.col(namespace), F.col(name)) for kind in ("table", "view")]
    return F.array(*qualified)


def depends_on(views: DataFrame, relations: DataFrame, namespace: str = "nspname", view: str = "relname", definition: str = "definition", limit: int | None = None) -> DataFrame:
    """Per view the sorted ids of the tables and views it reads: view_id, part, depends_on.

    `relations` has (namespace, relation_id) of all tables and views. Names resolve in the view's
    own namespace, table before view; names that resolve to nothing are left out.
    """
    edges = view_references(views, namespace, view, definition)
    resolved = resolve_by_priority(edges, ["view_id", "name"], _candidates(namespace, "name"), relations, [namespace], "relation_id")
    lists = distinct_sorted(resolved, ["view_id"], "resolved", "depends_on", limit)
    ids = views.select(object_id("view", F.col(namespace), F.col(view)).alias("view_id"))
    return with_lists(ids, lists, ["view_id"], "depends_on")


def unresolved(refs: DataFrame, ref_id: Sequence[str], candidates: Column, known: DataFrame, scope: Sequence[str], key: str) -> DataFrame:
    """References none of whose candidates exists."""
    answered = resolve_by_priority(refs, ref_id, candidates, known, scope, key, keep_unresolved=True)
    return answered.filter("resolved is null").drop("resolved")


def unresolved_views(views: DataFrame, relations: DataFrame, namespace: str = "nspname", view: str = "relname", definition: str = "definition") -> DataFrame:
    """Names read by views that no table or view of the namespace answers."""
    edges = view_references(views, namespace, view, definition)
    return unresolved(edges, ["view_id", "name"], _candidates(namespace, "name"), relations, [namespace], "relation_id")


def canonical_defaults(df: DataFrame, expression: str, column_type: str, out: str = "default") -> DataFrame:
    """Add the canonical default of a column expression under its type; null, with `<out>_error`, where something is never closed."""
    problem = text_problem(F.col(expression))
    form = F.when(problem.isNull(), canonical_default(F.col(expression), F.col(column_type)))
    return df.withColumns({out: form, f"{out}_error": problem})


def split_arguments(df: DataFrame, ids: Sequence[str], arguments: str) -> DataFrame:
    """One row per top-level argument: ids, ordinal, argument."""
    parts = df.select(*ids, F.posexplode(split_top_level(F.col(arguments))).alias("_at", "argument"))
    return parts.select(*ids, (F.col("_at") + 1).alias("ordinal"), "argument")


def name_collisions(df: DataFrame, id_column: str, safe: Column) -> DataFrame:
    """Different ids that share a safe name: safe_name, ids, first_id, last_id."""
    named = df.select(safe.alias("safe_name"), F.col(id_column).alias("_id")).distinct()
    shared = named.groupBy("safe_name").agg(F.count(F.lit(1)).alias("ids"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
    return shared.filter("ids > 1")
