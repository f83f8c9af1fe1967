"""Filters, joins, aggregates, ordinals and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.described_types import normal_type
from palimpsest.functions.names import object_id
from palimpsest.functions.texts import canonical_default, canonical_text
from palimpsest.operators import relational as R
from palimpsest.operators.aggregates import count_where, distinct_first_seen, distinct_sorted, duplicates, nest, ordered_list, unique_match, with_lists
from palimpsest.operators.corpus import depends_on, view_references
from palimpsest.operators.documents import assemble_namespaces, assemble_tables, canonical_order
from palimpsest.operators.ordinals import default_names, densify
from palimpsest.plans.inputs import CATALOG_SQL, HISTORY_SQL, Registry, catalog, history, listed, table
from palimpsest.session import large

registry = Registry()

# --- projections and filters --------------------------------------------------------------------


@registry.add(
    "p1_filter_user_namespaces",
    f"with {CATALOG_SQL} select ns_oid, nspname from namespaces where not starts_with(nspname, 'pg_') and nspname <> 'information_schema'",
)
def p1(spark, sf):
    return R.filter_user_namespaces(catalog(spark, sf)["namespaces"], "nspname")


@registry.add("p2_filter_kinds", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('O','P') and o_orderpriority <> '1-URGENT'")
def p2(spark, sf):
    kept = R.filter_kinds(table(spark, sf, "orders"), "o_orderstatus", ["O", "P"], "o_orderpriority", ["1-URGENT"])
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@registry.add("p3_filter_live", f"with {CATALOG_SQL} select ns_oid, attname, attnum from columns where attnum > 0 and not is_dropped")
def p3(spark, sf):
    return R.filter_live(catalog(spark, sf)["columns"]).select("ns_oid", "attname", "attnum")


@registry.add("p4_derive_flags", f"with {CATALOG_SQL} select ns_oid, attname, not not_null as nullable, identity <> '' as is_identity from columns")
def p4(spark, sf):
    return R.derive_flags(catalog(spark, sf)["columns"]).select("ns_oid", "attname", "nullable", "is_identity")


@registry.add(
    "p5_decode_codes",
    """select case l_returnflag when 'A' then 'accepted' when 'R' then 'returned' else l_returnflag end as flag, l_linestatus, count(*) as line_count
    from lineitem group by 1, 2""",
)
def p5(spark, sf):
    decoded = R.decode_codes(table(spark, sf, "lineitem"), "l_returnflag", {"A": "accepted", "R": "returned"}, "flag")
    return decoded.groupBy("flag", "l_linestatus").agg(F.count(F.lit(1)).alias("line_count"))


@registry.add(
    "p6_route_by_kind",
    """select event_id, case when event_type='purchase' then value end as purchase_value, case when event_type<>'purchase' or event_type is null then value end as other_value from events""",
)
def p6(spark, sf):
    routed = R.route_by_kind(table(spark, sf, "events"), "event_type", "purchase", "value", "purchase_value", "other_value")
    return routed.select("event_id", "purchase_value", "other_value")


# --- joins --------------------------------------------------------------------------------------


@registry.add(
    "j1_join_parents",
    """select r_name, n_name, o_orderstatus, count(*) as line_count, count(distinct o_custkey) as customers from lineitem join orders on l_orderkey=o_orderkey
    join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1, 2, 3""",
)
def j1(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    chain = R.join_parents(
        t["lineitem"].select("l_orderkey"),
        (t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus"), "l_orderkey", "o_orderkey"),
        (t["customer"].select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"),
        (t["nation"], "c_nationkey", "n_nationkey"),
        (t["region"], "n_regionkey", "r_regionkey"),
    )
    # Lines are counted per customer first, so the distinct count needs no second copy of the rows.
    per_customer = chain.groupBy("r_name", "n_name", "o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("_lines"))
    return per_customer.groupBy("r_name", "n_name", "o_orderstatus").agg(
        F.sum("_lines").alias("line_count"), F.count(F.lit(1)).alias("customers")
    )


@registry.add("j2_join_optional", "select d.doc_id, d.lang, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
def j2(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "label_doc")
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return R.join_optional(documents, labels, [("doc_id", "label_doc")]).select("doc_id", "lang", "quality", "toxic")


@registry.add("j3_not_backed_by", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j3(spark, sf):
    return R.not_backed_by(table(spark, sf, "customer"), table(spark, sf, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@registry.add(
    "j4_drop_orphans",
    """with parents as (select doc_id from documents where lang <> 'en')
    select 'kept' as what, doc_id as n from labels where doc_id in (from parents)
    union all select 'dropped', count(*) from labels where doc_id not in (from parents)""",
)
def j4(spark, sf):
    parents = table(spark, sf, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("parent_id"))
    kept, dropped = R.drop_orphans(table(spark, sf, "labels"), parents, [("doc_id", "parent_id")])
    return kept.select(F.lit("kept").alias("what"), F.col("doc_id").alias("n")).unionByName(dropped.select(F.lit("dropped").alias("what"), F.col("dropped").alias("n")))


@registry.add(
    "j5_role_join",
    """select cn.n_name as customer_nation, sn.n_name as supplier_nation, count(*) as line_count from lineitem join orders on l_orderkey=o_orderkey
    join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey join nation cn on c_nationkey=cn.n_nationkey join nation sn on s_nationkey=sn.n_nationkey group by 1, 2""",
)
def j5(spark, sf):
    lines = R.join_parents(
        table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"),
        (table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey"),
        (table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"),
        (table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey"),
    )
    played = R.role_join(lines, table(spark, sf, "nation"), "n_nationkey", {"customer": "c_nationkey", "supplier": "s_nationkey"})
    return played.groupBy(F.col("customer_n_name").alias("customer_nation"), F.col("supplier_n_name").alias("supplier_nation")).agg(
        F.count(F.lit(1)).alias("line_count")
    )


@registry.add(
    "j6_expand_positions",
    f"""with {CATALOG_SQL}, live as (select * from columns where not is_dropped),
    keys as (select c_custkey ns_oid, unnest([7, 1, 99, 4]) attnum, unnest([1, 2, 3, 4]) ord from customer)
    select k.ns_oid, k.ord, attname from keys k join live using (ns_oid, attnum)""",
)
def j6(spark, sf):
    columns = R.filter_live(catalog(spark, sf)["columns"]).select(F.col("ns_oid").alias("col_ns"), "attnum", "attname")
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("ns_oid"), F.expr("array(7, 1, 99, 4)").alias("conkey"))
    return R.expand_positions(keys, "conkey", columns, [("ns_oid", "col_ns")], "attnum").select("ns_oid", "ord", "attname")


RELATIONS_SQL = """relations as (select distinct ns_oid, relname, 'tbl' kind from columns union all select ns_oid, relname, 'view' from views),
reads as (select ns_oid, relname, lower(split_part(unnest(regexp_extract_all(definition, '(?i)\\b(?:from|join|update|into)\\s+([a-z0-9_.]+)', 1)), '.', -1)) name from views)"""


def _relations(found):
    tables = found["columns"].select("ns_oid", "relname").distinct().select("ns_oid", F.lit("table").alias("kind"), "relname")
    views = found["views"].select("ns_oid", F.lit("view").alias("kind"), "relname")
    both = tables.unionByName(views).join(found["namespaces"], "ns_oid")
    ids = F.when(F.col("kind") == "table", object_id("table", F.col("nspname"), F.col("relname"))).otherwise(
        object_id("view", F.col("nspname"), F.col("relname"))
    )
    return both.select("nspname", ids.alias("relation_id"))


@registry.add(
    "j7_resolve_by_priority",
    f"""with {CATALOG_SQL}, {RELATIONS_SQL}
    select 'view:'||nspname||'.'||r.relname as view_id, r.name, k.kind||':'||nspname||'.'||r.name as resolved
    from reads r join namespaces using (ns_oid) join (select ns_oid, relname, min(kind) kind from relations group by 1, 2) k on k.ns_oid=r.ns_oid and k.relname=r.name""",
)
def j7(spark, sf):
    found = catalog(spark, sf)
    edges = view_references(found["views"].join(found["namespaces"], "ns_oid"))
    candidates = F.array(*[object_id(k, F.col("nspname"), F.col("name")) for k in ("table", "view")])
    resolved = R.resolve_by_priority(edges, ["view_id", "name"], candidates, _relations(found), ["nspname"], "relation_id")
    return resolved.select("view_id", "name", "resolved")


# --- aggregates ---------------------------------------------------------------------------------


@registry.add(
    "a1_ordered_list",
    "select l_orderkey, 0 as part, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) as parts from lineitem group by 1",
)
def a1(spark, sf):
    lists = ordered_list(table(spark, sf, "lineitem"), ["l_orderkey"], "l_partkey", ["l_linenumber", "l_partkey"], "parts")
    return lists.select("l_orderkey", "part", listed("parts"))


@registry.add(
    "a1_with_empty",
    """select o_orderkey, 0 as part, coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber), '') as returned
    from orders left join lineitem on l_orderkey=o_orderkey and l_returnflag='R' group by 1""",
)
def a1_empty(spark, sf):
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    lists = ordered_list(returned, ["o_orderkey"], "l_linenumber", ["l_linenumber"], "returned")
    return with_lists(table(spark, sf, "orders").select("o_orderkey"), lists, ["o_orderkey"], "returned").select("o_orderkey", "part", listed("returned"))


@registry.add("a2_labels_per_group", "select conv_id, 0 as part, string_agg(role, ',' order by turn, role) as roles from conversations group by 1")
def a2(spark, sf):
    lists = ordered_list(table(spark, sf, "conversations"), ["conv_id"], "role", ["turn", "role"], "roles")
    return lists.select("conv_id", "part", listed("roles"))


@registry.add(
    "a3_orders_with_lines",
    """select o_orderkey, o_orderstatus, 0 as part, coalesce(string_agg(l_linenumber::varchar||':'||l_partkey::varchar||':'||l_suppkey::varchar, ',' order by l_linenumber, l_partkey, l_suppkey), '') as lines
    from orders left join lineitem on l_orderkey=o_orderkey group by 1, 2""",
)
def a3_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    element = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    nested = nest(orders, ["o_orderkey"], lines=(lines, element, ["l_linenumber", "l_partkey", "l_suppkey"]))
    text = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")))
    return nested.select("o_orderkey", "o_orderstatus", "part", F.array_join(text, ",").alias("lines"))


def catalog_tables(spark, sf):
    """Table documents of the derived catalog."""
    found = catalog(spark, sf)
    names = R.filter_user_namespaces(found["namespaces"], "nspname")
    columns = R.derive_flags(R.filter_live(found["columns"])).join(names, "ns_oid")
    kind = normal_type(F.col("type_name"), "catalog")
    shaped = columns.select(
        "nspname", "relname", F.col("attname").alias("name"), kind.alias("type"), "nullable",
        F.when(F.col("generated_kind") == "s", "").otherwise(canonical_default(F.col("expression"), kind)).alias("default"),
    )
    constraints = found["constraints"].join(names, "ns_oid").select(
        "nspname", F.lit("users").alias("relname"), F.col("conname").alias("name"), F.col("contype").alias("type"), "columns"
    )
    indexes = found["indexes"].join(names, "ns_oid").select(
        "nspname", F.col("tablename").alias("relname"), F.col("relname").alias("name"), "columns", F.lit("btree").alias("method"),
        F.col("is_unique").alias("unique"), canonical_text(F.col("predicate")).alias("predicate"),
    )
    return assemble_tables(shaped, constraints, indexes)


def catalog_namespaces(spark, sf):
    """Namespace documents of the derived catalog."""
    found = catalog(spark, sf)
    names = R.filter_user_namespaces(found["namespaces"], "nspname")
    ns = F.col("nspname")
    views = found["views"].join(names, "ns_oid")
    reads = depends_on(views, _relations(found)).select(F.col("view_id").alias("id"), "part", "depends_on")
    shown = views.select("nspname", object_id("view", ns, F.col("relname")).alias("id"), canonical_text(F.col("definition")).alias("definition"))
    labels = ordered_list(found["enums"].join(names, "ns_oid"), ["nspname", "typname"], "label", ["sortorder"], "labels")
    enums = labels.select("nspname", object_id("enum", ns, F.col("typname")).alias("id"), "part", "labels")
    sequences = found["sequences"].join(names, "ns_oid")
    sequences = sequences.select("nspname", object_id("sequence", ns, F.col("seqname")).alias("id"), "data_type", "start", "increment")
    return assemble_namespaces(catalog_tables(spark, sf).drop("relname"), shown.join(large(reads, ["id"]), "id"), enums, sequences)


_TABLE_DOC_SQL = """users as (select ns_oid, nspname from namespaces where not starts_with(nspname, 'pg_') and nspname <> 'information_schema')"""


@registry.add(
    "a3_table_documents",
    f"""with {CATALOG_SQL}, {_TABLE_DOC_SQL} select 'tbl:'||nspname||'.users' as id, 0 as part,
      'email/1/varchar(255)/false/''unknown''::character varying(255),id/2/int8/false/nextval(''user_id_seq''::regclass),role/3/user_role/false/,score/4/numeric(10,2)/true/,seen/5/timestamptz[]/true/' as columns,
      'bad_arity,bad_col,bad_kind,no_target,two_pk_a,two_pk_b' as constraints,
      'bad_col_idx//false,users_email_idx//false,users_seen_idx/(seen is not null)/true' as indexes from users""",
)
def a3_tables(spark, sf):
    docs = catalog_tables(spark, sf)
    column = F.transform("columns", lambda c: F.concat_ws("/", c["name"], c["ordinal"].cast("string"), c["type"], c["nullable"].cast("string"), c["default"]))
    index = F.transform("indexes", lambda i: F.concat_ws("/", i["name"], F.coalesce(i["predicate"], F.lit("")), i["unique"].cast("string")))
    return docs.select(
        "id", "part", F.array_join(column, ",").alias("columns"),
        F.array_join(F.transform("constraints", lambda c: c["name"]), ",").alias("constraints"), F.array_join(index, ",").alias("indexes"),
    )


@registry.add(
    "a3_namespace_documents",
    f"""with {CATALOG_SQL}, {_TABLE_DOC_SQL} select 'ns:'||nspname as id, 0 as part, 'tbl:'||nspname||'.users:5' as tables,
      'active(tbl:'||nspname||'.users),broken(),constant(),recent(view:'||nspname||'.active)' as views, 'admin|member' as enums, 4 as sequences from users""",
)
def a3_namespaces(spark, sf):
    docs = catalog_namespaces(spark, sf)
    tables = F.transform("tables", lambda t: F.concat_ws(":", t["id"], F.size(t["columns"]).cast("string")))
    views = F.transform("views", lambda v: F.concat(F.substring_index(v["id"], ".", -1), F.lit("("), F.array_join(v["depends_on"], "|"), F.lit(")")))
    enums = F.transform("enums", lambda e: F.array_join(e["labels"], "|"))
    return docs.select(
        "id", "part", F.array_join(tables, ",").alias("tables"), F.array_join(views, ",").alias("views"), F.array_join(enums, ",").alias("enums"), F.size("sequences").alias("sequences")
    )


@registry.add("a4_distinct_sorted", "select user_id, 0 as part, string_agg(distinct event_type, ',' order by event_type) as types from events where event_type is not null group by 1")
def a4(spark, sf):
    return distinct_sorted(table(spark, sf, "events"), ["user_id"], "event_type", "types").select("user_id", "part", listed("types"))


@registry.add(
    "a5_distinct_first_seen",
    "select user_id, 0 as part, string_agg(event_type, ',' order by seen, event_type) as types from (select user_id, event_type, min(event_id) seen from events group by 1, 2) group by 1",
)
def a5(spark, sf):
    return distinct_first_seen(table(spark, sf, "events"), ["user_id"], "event_type", "event_id", "types").select("user_id", "part", listed("types"))


@registry.add("a6_duplicates", "select l_orderkey, l_linenumber, count(*) as times from lineitem group by 1, 2 having count(*) > 1")
def a6(spark, sf):
    return duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@registry.add("a7_count_where", "select l_orderkey, count(*) as matches from lineitem where l_returnflag='R' group by 1 having count(*) > 1")
def a7(spark, sf):
    return count_where(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", 1)


@registry.add(
    "a10_unique_match",
    f"""with recursive {HISTORY_SQL} select repo_id, substr(sha,1,1) as prefix, case when count(distinct sha)=1 then min(sha) end as match,
      case when count(distinct sha)=1 then 'ok' else 'ambiguous' end as status from commits group by 1, 2""",
)
def a10(spark, sf):
    commits = history(spark, sf)["commits"].withColumn("prefix", F.substring("sha", 1, 1))
    return unique_match(commits, ["repo_id", "prefix"], "sha")


# --- ordinals and names -------------------------------------------------------------------------


@registry.add(
    "w1_densify",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as ordinal from lineitem""",
)
def w1(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return densify(table(spark, sf, "lineitem"), ["l_orderkey"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "ordinal"
    )


_MEMBERS_SQL = """members as (select c_custkey, c_nationkey, lower(c_mktsegment)||'_check' stem,
  case when c_custkey%4=0 then lower(c_mktsegment)||'_check'||case when c_custkey%9=0 then '' else (c_custkey%9)::varchar end end name from customer)"""


@registry.add(
    "w2_default_names",
    f"""with {_MEMBERS_SQL}, asked as (select *, row_number() over (partition by c_nationkey, stem order by c_custkey) r from members where name is null),
    slots as (select c_nationkey, stem, unnest(range(0, n + 10)) i from (select c_nationkey, stem, count(*) n from members group by 1, 2)),
    free as (select c_nationkey, stem, i, row_number() over (partition by c_nationkey, stem order by i) r from slots s
      where not exists (select 1 from members m where m.c_nationkey=s.c_nationkey and m.stem=s.stem and m.name = s.stem||case when i=0 then '' else i::varchar end))
    select c_custkey, c_nationkey, stem||case when i=0 then '' else i::varchar end as name from asked join free using (c_nationkey, stem, r)
    union all select c_custkey, c_nationkey, name from members where name is not null""",
)
def w2(spark, sf):
    stem = F.concat(F.lower("c_mktsegment"), F.lit("_check"))
    number = F.expr("case when c_custkey % 9 = 0 then '' else cast(c_custkey % 9 as string) end")
    members = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", stem.alias("stem"), F.when(F.expr("c_custkey % 4 = 0"), F.concat(stem, number)).alias("name")
    )
    return default_names(members, ["c_nationkey"], "name", "stem", ["c_custkey"]).select("c_custkey", "c_nationkey", "name")


_CLASH = "select *, case c_custkey%5 when 0 then 'm_check' when 1 then 'm_check1' when 2 then 'k' else lower(c_mktsegment) end stem, case c_custkey%7 when 0 then 'm_check'||(c_custkey%4)::varchar when 1 then 'k_check' end as name from customer"


@registry.add("w2_names_are_unique", f"select c_nationkey, count(*) as members, count(*) filter (name is null) as filled, 0::bigint as clashes from ({_CLASH}) group by 1")
def w2_unique(spark, sf):
    """Stems that run into each other's numbers, and names given under another stem: filled names clash with none."""
    given = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey", "case c_custkey % 5 when 0 then 'm_check' when 1 then 'm_check1' when 2 then 'k' else lower(c_mktsegment) end as stem",
        "case c_custkey % 7 when 0 then concat('m_check', c_custkey % 4) when 1 then 'k_check' end as name", "c_custkey % 7 > 1 as open",
    )
    named = default_names(given, ["c_nationkey"], "name", "stem", ["c_custkey"])
    per = named.groupBy("c_nationkey", "name").agg(F.count("*").alias("n"), F.count_if("open").alias("filled"))
    clashes = F.sum(F.when(F.col("filled") > 0, F.col("n") - 1).otherwise(0))
    return per.groupBy("c_nationkey").agg(F.sum("n").alias("members"), F.sum("filled").alias("filled"), clashes.alias("clashes"))


# --- orders and sets ----------------------------------------------------------------------------


@registry.add("o1_stable_order", "select o_orderpriority, o_orderstatus, o_orderkey from orders order by 1, 2, 3")
def o1(spark, sf):
    return R.stable_order(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey"), "o_orderpriority", "o_orderstatus", "o_orderkey")


@registry.add(
    "o2_canonical_order",
    """select o_orderkey, coalesce(string_agg(id||'<'||tags||'>', ',' order by id), '') as lines from orders left join
      (select l_orderkey, min(l_suppkey)::varchar tags, l_partkey::varchar id from lineitem group by l_orderkey, l_partkey) on l_orderkey=o_orderkey group by 1""",
)
def o2(spark, sf):
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("id"))
        .agg(F.min("l_suppkey").cast("string").alias("tag"))
    )
    # Members are gathered in another order first, so that sorting by id has something to do.
    nested = nest(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], lines=(lines, F.struct("tag", "id"), ["tag", "id"]))
    ordered = nested.select("o_orderkey", canonical_order(F.col("lines"), nested.schema["lines"].dataType).alias("lines"))
    text = F.transform("lines", lambda x: F.concat(x["id"], F.lit("<"), x["tag"], F.lit(">")))
    return ordered.select("o_orderkey", F.array_join(text, ",").alias("lines"))


@registry.add("u1_all_namespaces", "select c_nationkey as nation from customer union select s_nationkey from supplier")
def u1(spark, sf):
    return R.all_keys("nation", (table(spark, sf, "customer"), "c_nationkey"), (table(spark, sf, "supplier"), "s_nationkey"))
