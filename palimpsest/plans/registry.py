"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from palimpsest.plans import content, corpus, history, relational, rules, versions
from palimpsest.plans.inputs import Query

FAMILIES = (content, relational, versions, history, corpus, rules)


def all_queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.registry.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.registry.sql.items()}
