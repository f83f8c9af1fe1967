"""Texts: segments, canonical forms, references and defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.names import object_id
from palimpsest.operators import corpus as T
from palimpsest.plans.inputs import CATALOG_SQL, Registry, catalog, listed, table
from palimpsest.plans.relational import RELATIONS_SQL, _relations
from palimpsest.session import dealt

registry = Registry()


@registry.add(
    "t1_segment",
    """with p as (select doc_id, unnest(string_split(text, chr(10))) piece, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
    q as (select doc_id, i, regexp_replace(piece, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') piece from p)
    select doc_id, row_number() over (partition by doc_id order by i) as ordinal, piece from q where piece <> ''""",
)
def t1(spark, sf):
    return T.segment(table(spark, sf, "documents"), ["doc_id"], "text", "\n")


# The same steps in the other engine's regular expressions, which have no possessive repeats.
_NAME = r"A-Za-z0-9_\x{80}-\x{10FFFF}"
_QUOTED = r"""''[^'']*(?:''''[^'']*)*''|\$\$(?s:.*?)\$\$|"[^"]*(?:""[^"]*)*["]"""
_WITH_COMMENTS = _QUOTED + rf"""|--[^\n]*|/\*(?s:.*?)\*/|[^''"/\-$]*[{_NAME}]\$+|[^''"/\-$]+|(?s:.)"""
_WITHOUT_COMMENTS = _QUOTED + rf"""|[^''"$]*[{_NAME}]\$+|[^''"$]+|(?s:.)"""
_CAST = r"\s*::\s*[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*(?:\s*\([^)]*\))?(?:\s+(?:varying|precision|without|with|time|zone)\b)*(?:\s*\([^)]*\))?(?:\s*\[\])*"


def canonical_sql(text: str) -> str:
    plain = "lower(x)"
    for pattern, by in (
        (r"\bpublic\s*\.\s*", ""),
        (_CAST, ""),
        (r"[ \t\n\x0B\f\r]+", " "),
        (r" ?([,)\]]) ?", r"\1 "),
        (r"([(\[]) ", r"\1"),
        (r" ([,)\]])", r"\1"),
    ):
        plain = f"regexp_replace({plain}, '{pattern}', '{by}', 'g')"
    bare = (
        f"""case when regexp_matches({text}, '--|/\\*') then array_to_string(list_transform(regexp_extract_all({text}, '({_WITH_COMMENTS})', 1), """
        f"""lambda x: case when regexp_matches(x, '^(--|/\\*)') then ' ' else x end), '') else {text} end"""
    )
    kept = f"""case when regexp_matches(x, '^(?:[''"](?s:.)|\\$[A-Za-z0-9_]*\\$)') then x else {plain} end"""
    joined = f"array_to_string(list_transform(regexp_extract_all({bare}, '({_WITHOUT_COMMENTS})', 1), lambda x: {kept}), '')"
    return rf"regexp_replace({joined}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r;]+$', '', 'g')"


@registry.add("t2_canonical_ids", f"select doc_id, sha256({canonical_sql('text')}) as text_hash from documents")
def t2_ids(spark, sf):
    return T.canonical_ids(table(spark, sf, "documents"), ["doc_id"], "text")


@registry.add("t2_canonical_groups", f"select sha256({canonical_sql('text')}) as text_hash, count(*) as texts, min(doc_id) as first_id from documents group by 1")
def t2(spark, sf):
    return T.canonical_groups(table(spark, sf, "documents"), "doc_id", "text")


@registry.add("t2_canonical_views", f"with {CATALOG_SQL} select ns_oid, relname, {canonical_sql('definition')} as definition from views")
def t2_views(spark, sf):
    views = catalog(spark, sf)["views"]
    return views.select("ns_oid", "relname", T.canonical_text(F.col("definition")).alias("definition"))


#: Statements that quote between dollar marks, or open something and never close it; # is the customer.
_STATEMENTS = (
    "$$Hello  World#$$", "$$hello world#$$", "SELECT $$A  b$$, #", "select  $$A  b$$ ,#", "select 'open#", 'select "open#', "select # /* open", "select $$open#",
    "select 'it''s' -- don't", "select a$$b, #",
)
_ROWS = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(_STATEMENTS))
_STATEMENTS_SQL = f"statements as (select c_custkey, v.i, replace(v.t, '#', c_custkey::varchar) stmt from customer, (values {_ROWS}) v(i, t))"


def _statements(spark, sf):
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(_STATEMENTS)]))
    given = dealt(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", rows.alias("x"))
    return given.select("c_custkey", "x.i", F.replace(F.col("x.t"), F.lit("#"), F.col("c_custkey").cast("string")).alias("stmt"))


@registry.add(
    "t2_broken_texts",
    f"with {_STATEMENTS_SQL} select c_custkey, i, case i when 4 then 'open text' when 5 then 'open name' when 6 then 'open comment' else 'open dollar text' end as problem from statements where i in (4, 5, 6, 7)",
)
def t2_broken(spark, sf):
    return T.broken_texts(_statements(spark, sf), ["c_custkey", "i"], "stmt")


@registry.add("t2_quoted_groups", f"with {_STATEMENTS_SQL} select c_custkey, case i when 3 then 2 else i end as first_id, count(*) as texts from statements group by 1, 2")
def t2_quoted(spark, sf):
    """Groups of equal statements of a customer: what stands between dollar marks counts as written."""
    hashed = T.canonical_ids(_statements(spark, sf), ["c_custkey", "i"], "stmt")
    return hashed.groupBy("c_custkey", "text_hash").agg(F.min("i").alias("first_id"), F.count("*").alias("texts")).drop("text_hash")


@registry.add(
    "t6_broken_defaults",
    f"""with {_STATEMENTS_SQL} select c_custkey, i, case when i < 2 then stmt end as "default" from statements where i in (0, 1, 4, 5, 6, 7)""",
)
def t6_broken(spark, sf):
    given = _statements(spark, sf).filter("i in (0, 1, 4, 5, 6, 7)").withColumn("kind", F.lit("text"))
    return T.canonical_defaults(given, "stmt", "kind").select("c_custkey", "i", "default")


_HREF = 'href="([^"]*)"'
_LINKS_SQL = f"""raw as (select page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) name, generate_subscripts(regexp_extract_all(html, '{_HREF}', 1), 1) i from pages),
links as (select page_id, name, row_number() over (partition by page_id order by min(i)) - 1 position from raw group by page_id, name)"""


@registry.add("t3_page_links", f"with {_LINKS_SQL} select page_id, name, position from links")
def t3_pages(spark, sf):
    return T.extract_mentions(table(spark, sf, "pages"), ["page_id"], "html", _HREF)


@registry.add("t3_view_references", f"with {CATALOG_SQL}, {RELATIONS_SQL} select ns_oid, relname, name, 0 as position from reads")
def t3_views(spark, sf):
    return T.extract_references(catalog(spark, sf)["views"], ["ns_oid", "relname"], "definition")


@registry.add(
    "t4_depends_on",
    f"""with {CATALOG_SQL}, {RELATIONS_SQL}, kinds as (select ns_oid, relname, min(kind) kind from relations group by 1, 2)
    select 'view:'||nspname||'.'||v.relname as view_id, 0 as part, coalesce(string_agg(distinct k.kind||':'||nspname||'.'||k.relname, ',' order by k.kind||':'||nspname||'.'||k.relname), '') as depends_on
    from views v join namespaces n using (ns_oid) left join reads r on r.ns_oid=v.ns_oid and r.relname=v.relname left join kinds k on k.ns_oid=v.ns_oid and k.relname=r.name group by 1""",
)
def t4(spark, sf):
    found = catalog(spark, sf)
    return T.depends_on(found["views"].join(found["namespaces"], "ns_oid"), _relations(found)).select("view_id", "part", listed("depends_on"))


@registry.add("t5_unresolved_views", f"with {CATALOG_SQL} select 'view:'||nspname||'.broken' as view_id, 'missing' as name from namespaces")
def t5_views(spark, sf):
    found = catalog(spark, sf)
    return T.unresolved_views(found["views"].join(found["namespaces"], "ns_oid"), _relations(found)).select("view_id", "name")


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_PATH = "regexp_replace(url, '^[a-z]+://[^/]+|[?].*$', '', 'g')"


@registry.add(
    "t5_unresolved_links",
    f"""with {_LINKS_SQL}, known as (select distinct unnest([url, {_HOST}||{_PATH}, {_HOST}]) target from pages)
    select l.page_id, l.name from links l join pages p using (page_id)
    where l.name not in (from known) and regexp_extract(p.url, '^[a-z]+://([^/]+)', 1)||l.name not in (from known)""",
)
def t5_pages(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.regexp_replace("url", "^[a-z]+://[^/]+|[?].*$", "")
    everywhere = F.lit(1).alias("web")
    known = pages.select(everywhere, F.explode(F.array("url", F.concat(host, path), host)).alias("target"))
    links = T.extract_mentions(pages.withColumn("host", host), ["page_id", "host"], "html", _HREF)
    candidates = F.array("name", F.concat("host", "name"))
    return T.unresolved(links, ["page_id", "name"], candidates, known, [], "target").select("page_id", "name")


@registry.add(
    "t6_canonical_defaults",
    f"""with {CATALOG_SQL}, typed as (select *, case attname when 'id' then 'int8' when 'email' then 'varchar(255)' when 'role' then 'user_role' else 'text' end kind from columns)
    select ns_oid, attname, case attname when 'id' then 'nextval(''user_id_seq''::regclass)' when 'email' then '''unknown''::character varying(255)'
      when 'role' then 'null::user_role' when 'score' then 'a + b' when 'seen' then 'now()' else '' end as "default" from typed""",
)
def t6(spark, sf):
    columns = catalog(spark, sf)["columns"]
    given = F.expr("case attname when 'role' then 'NULL' when 'seen' then 'NOW()' else expression end")
    kind = F.expr("case attname when 'id' then 'int8' when 'email' then 'varchar(255)' when 'role' then 'user_role' else 'text' end")
    prepared = columns.withColumns({"given": given, "kind": kind})
    return T.canonical_defaults(prepared, "given", "kind").select("ns_oid", "attname", "default")
