"""Sources, sinks, hashing and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.described_types import normal_type, normalise_types, type_parts
from palimpsest.functions.encoding import content_id, empty_as_absent
from palimpsest.functions.names import default_namespace, is_hash, is_ref, object_id, safe_name, unqualify
from palimpsest.functions.texts import collapse_space, screen_text
from palimpsest.operators.corpus import name_collisions, split_arguments
from palimpsest.operators.fingerprints import bucket_hashes, group_hash, table_hash
from palimpsest.plans.inputs import BROKEN_SQL, CATALOG_SQL, HISTORY_SQL, VERSIONS_SQL, Registry, broken, catalog, commit_sha, encoded, history, listed, scratch, table, versions
from palimpsest.session import durable, large
from palimpsest.sources.catalog import read_catalog, write_catalog
from palimpsest.sources.commits import PAYLOAD, read_commits, verify_commits, with_commit_ids, write_commits
from palimpsest.sources.conflicts import read_conflicts, write_conflicts
from palimpsest.sources.migrations import applied_ids, list_migrations, read_ledger, read_migrations, with_checksums, write_migrations
from palimpsest.sources.objects import append_index, append_new, create_index, put_if_absent, put_into, read_objects, verify_objects
from palimpsest.sources.strict_json import strict_json
from palimpsest.operators.schema_hash import namespace_hashes, schema_hash, table_hashes
from palimpsest.operators.versions import conflicts, merge3

registry = Registry()

# --- sources and sinks --------------------------------------------------------------------------


@registry.add(
    "s1_read_catalog",
    f"""with {CATALOG_SQL}
    select relation, count(*) as row_count from (
      select 'columns' relation from columns union all select 'views' from views union all select 'sequences' from sequences
      union all select 'enums' from enums union all select 'indexes' from indexes union all select 'constraints' from constraints
      union all select 'namespaces' from namespaces) group by relation""",
)
def s1(spark, sf):
    found = catalog(spark, sf)
    no_rows = found["views"].limit(0)
    # Relations the test catalog does not have are stored empty.
    stored = {
        **found,
        "constraints": found["constraints"].selectExpr("ns_oid", "'users' relname", "conname", "contype", "columns", "string(null) expression", "referenced_table", "referenced_columns"),
        "indexes": found["indexes"].selectExpr("ns_oid", "relname", "tablename", "columns", "'btree' method", "is_unique", "predicate"),
        "functions": no_rows.selectExpr("ns_oid", "relname proname", "definition arguments", "definition return_type", "definition language", "definition"),
    }
    path = scratch(spark, "catalog")
    write_catalog(stored, path)
    back = read_catalog(spark, path)
    counts = None
    for name, df in back.items():
        one = df.groupBy(F.lit(name).alias("relation")).agg(F.count(F.lit(1)).alias("row_count"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


STORE_SQL = """held as (select sha256(text) sha, case when doc_id%30=0 then text||'!' else text end content
       from documents where doc_id%3=0),
offered as (select distinct sha256(text) sha, text content from documents),
held_range as (select sha, min(content) low, max(content) high from held group by sha)"""


def _store(spark, sf):
    documents = table(spark, sf, "documents")
    return documents.filter("doc_id % 3 = 0").select(
        F.sha2("text", 256).alias("sha"), F.expr("case when doc_id % 30 = 0 then concat(text, '!') else text end").alias("content")
    )


@registry.add(
    "s2_put_if_absent",
    f"""with {STORE_SQL} select o.sha, case when h.sha is null then 'new' when low=o.content and high=o.content then 'existing' else 'collision' end as outcome
    from offered o left join held_range h on o.sha=h.sha""",
)
def s2(spark, sf):
    return put_if_absent(table(spark, sf, "documents"), _store(spark, sf), "text").select("sha", "outcome")


@registry.add(
    "s2_append_new",
    f"""with {STORE_SQL} select o.sha, strlen(o.content) as content_bytes from offered o left join held h on o.sha=h.sha where h.sha is null""",
)
def s2_append(spark, sf):
    path = scratch(spark, "objects")
    append_new(put_if_absent(table(spark, sf, "documents"), _store(spark, sf), "text"), path, digits=1)
    return read_objects(spark, path, digits=1).select("sha", F.octet_length("content").cast("bigint").alias("content_bytes"))


@registry.add(
    "s2_put_into_index",
    f"""with {STORE_SQL} select o.sha, case when h.sha is null then 'new' when low=o.content and high=o.content then 'existing' else 'collision' end as outcome
    from offered o left join held_range h on o.sha=h.sha""",
)
def s2_index(spark, sf):
    """Against the bucketed index of a store, which is joined as it lies."""
    path = scratch(spark, "index")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    create_index(spark, name, path, 8)
    append_index(_store(spark, sf).withColumn("outcome", F.lit("new")), name, 8)
    return put_into(table(spark, sf, "documents"), name, "text").select("sha", "outcome")


@registry.add("s3_verify_objects", f"with {BROKEN_SQL} select doc_id, stored, sha256(text) as actual from tampered where stored <> sha256(text)")
def s3(spark, sf):
    return verify_objects(broken(spark, sf)["tampered"], "stored", "text").select("doc_id", "stored", "actual")


COMMIT_SQL = f"""
p as (select child, list(parent order by idx) ps, string_agg('64:'||parent, '' order by idx) pt, count(*) np from edges group by child),
c as (select s.repo_id, sha256(o.o_orderstatus) schema_hash, case when o.o_orderkey%2=0 then 'm'||o.o_orderkey::varchar else '' end migration_id,
   'user'||s.repo_id::varchar author, strftime(s.ts - interval 9 hour, '%Y-%m-%d %H:%M:%S.%f') ts, o.o_orderpriority message,
   np||'['||pt||']' parents, s.o_orderkey
   from s join orders o on o.o_orderkey=s.o_orderkey left join p on p.child=s.sha)"""


def _commit_rows(spark, sf):
    h = history(spark, sf)
    # Commits and their parents meet by the keys of their orders; names are made of them afterwards.
    parents = h["links"].groupBy(F.col("child").alias("own")).agg(F.collect_list(F.struct("idx", "parent")).alias("ps"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = h["numbered"].join(large(orders, ["o_orderkey"]), "o_orderkey").join(parents.hint("merge"), F.col("o_orderkey") == F.col("own"), "left")
    rows = rows.withColumn("ps", F.array_sort(F.transform("ps", lambda x: F.struct(x["idx"].alias("idx"), commit_sha(x["parent"]).alias("parent")))))
    return rows.select(
        "repo_id",
        "o_orderkey",
        F.transform("ps", lambda x: x["parent"]).alias("parents"),
        F.sha2("o_orderstatus", 256).alias("schema_hash"),
        F.expr("case when o_orderkey % 2 = 0 then concat('m', o_orderkey) else '' end").alias("migration_id"),
        F.concat(F.lit("user"), F.col("repo_id").cast("string")).alias("author"),
        "ts",
        F.col("o_orderpriority").alias("message"),
        F.lit("").alias("risk_level"),
    )


@registry.add(
    "s4_write_commits",
    f"""with recursive {HISTORY_SQL}, {COMMIT_SQL}
    select repo_id, o_orderkey, sha256({encoded("parents$", "schema_hash$", "nullif(migration_id,'')$", "author$", "ts$", "message$", "null$")}) as sha, ts from c""",
)
def s4(spark, sf):
    return with_commit_ids(_commit_rows(spark, sf), "Asia/Tokyo")[0].select("repo_id", "o_orderkey", "sha", "ts")


_PAYLOAD = ("parents$", "schema_hash$", "nullif(migration_id,'')$", "author$", "ts$", "message$", "null$")
_COMMIT_HASH = f"sha256({encoded(*_PAYLOAD)})"


@registry.add("s4_round_trip", f"with recursive {HISTORY_SQL}, {COMMIT_SQL} select distinct {_COMMIT_HASH} as sha, author, ts, message from c")
def s4_round_trip(spark, sf):
    """Commits written twice, read back, and checked against their hashes."""
    path = scratch(spark, "commits")
    commits = durable(with_commit_ids(_commit_rows(spark, sf), "Asia/Tokyo")[0], "zstd")
    for _ in range(2):
        write_commits(commits, path)
    # Copies are told apart once, for the check and for the result.
    back = durable(read_commits(spark, path).select("sha", *PAYLOAD), "zstd")
    broken = durable(verify_commits(back).select("sha"))
    return back.join(broken, "sha", "left_anti").select("sha", "author", "ts", "message")


@registry.add("s4_read_some", f"with recursive {HISTORY_SQL}, {COMMIT_SQL} select distinct {_COMMIT_HASH} as sha, author from c where starts_with({_COMMIT_HASH}, '0')")
def s4_some(spark, sf):
    """Commits asked for by hash come from their prefix folders."""
    path = scratch(spark, "commits")
    commits = durable(with_commit_ids(_commit_rows(spark, sf), "Asia/Tokyo")[0], "zstd")
    write_commits(commits, path)
    return read_commits(spark, path, commits.where("sha like '0%'").select("sha")).select("sha", "author")


@registry.add("s4_refused", f"with recursive {HISTORY_SQL} select repo_id, o_orderkey, 'invalid schema hash' as reason from s where o_orderkey%50=0")
def s4_refused(spark, sf):
    rows = _commit_rows(spark, sf).withColumn("schema_hash", F.expr("case when o_orderkey % 50 = 0 then 'none' else schema_hash end"))
    return with_commit_ids(rows, "Asia/Tokyo")[1].select("repo_id", "o_orderkey", "reason")


@registry.add(
    "s6_migrations",
    f"with {BROKEN_SQL} select migration_id, sha256(up_sql) as checksum, strlen(up_sql) as up_bytes, down_sql from stored_migrations",
)
def s6(spark, sf):
    path = scratch(spark, "migrations")
    write_migrations(broken(spark, sf)["migrations"], path)
    return read_migrations(spark, path).select("migration_id", "checksum", F.octet_length("up_sql").cast("bigint").alias("up_bytes"), "down_sql")


@registry.add("s6_list_migrations", f"with {BROKEN_SQL} select migration_id from stored_migrations order by 1")
def s6_list(spark, sf):
    return list_migrations(with_checksums(broken(spark, sf)["migrations"])[0])


@registry.add(
    "s7_conflicts",
    f"""with {VERSIONS_SQL}
    select 'row:orders.'||k::varchar as object_id, case when b.k is null then 'add_add' when o.k is null or t.k is null then 'modify_delete' else 'field' end as kind
    from base b full join ours o using (k) full join theirs t using (k)
    where (o.k is null) <> (t.k is null) and b.k is not null and (o.k is null or o.s is distinct from b.s or o.p is distinct from b.p or o.r is distinct from b.r)
          and (t.k is null or t.s is distinct from b.s or t.p is distinct from b.p or t.r is distinct from b.r)
       or b.k is null and o.k is not null and t.k is not null and (o.s is distinct from t.s or o.p is distinct from t.p or o.r is distinct from t.r)
       or b.k is not null and o.k is not null and t.k is not null and (
          (o.s is distinct from t.s and o.s is distinct from b.s and t.s is distinct from b.s)
          or (o.p is distinct from t.p and o.p is distinct from b.p and t.p is distinct from b.p)
          or (o.r is distinct from t.r and o.r is distinct from b.r and t.r is distinct from b.r))""",
)
def s7(spark, sf):
    base, ours, theirs = versions(spark, sf)
    path = scratch(spark, "conflicts")
    write_conflicts(conflicts(merge3(base, ours, theirs, ["k"]), ["k"], "orders"), "m1", path)
    return read_conflicts(spark, path, "m1").select("object_id", "kind")


@registry.add("s8_applied_ids", f"with {BROKEN_SQL} select migration_id from ledger")
def s8(spark, sf):
    path = scratch(spark, "ledger")
    broken(spark, sf)["ledger"].withColumn("applied_at", F.lit(None).cast("timestamp")).write.parquet(path)
    return applied_ids(read_ledger(spark, path))


@registry.add(
    "s9_strict_json",
    f"""with {BROKEN_SQL} select event_id, case when not json_valid(props) then 'malformed' else 'unknown keys' end as problem,
      case when json_valid(props) then array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') else '' end as unknown_keys
    from broken_events where not json_valid(props) or len(list_filter(json_keys(case when json_valid(props) then props else '{{}}' end), lambda x: x <> 'k')) > 0""",
)
def s9(spark, sf):
    return strict_json(broken(spark, sf)["events"], "props", ["k"]).select("event_id", "problem", listed("unknown_keys"))


# --- hashing ------------------------------------------------------------------------------------

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TEXT_COLUMNS = {"l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"}


def _marked(columns: list[str]) -> list[str]:
    return [c + "$" if c in TEXT_COLUMNS else c for c in columns]


_LANES = ", ".join(f"sum(('0x'||substr(h,{1 + 5 * i},5))::bigint)::varchar l{i}" for i in range(9))
_DIGEST = "sha256(n::varchar" + "".join(f"||'|'||l{i}" for i in range(9)) + ")"


def _table_hash_sql(name: str, columns: list[str]) -> str:
    return f"""with h as (select sha256({encoded(*_marked(columns))}) h from {name}),
    b as (select substr(h,1,2) bucket, count(*) n, {_LANES} from h group by 1)
    select sum(n)::bigint as row_count, sha256('{"|".join(f"{len(n)}:{n}" for n in columns)}'||chr(10)||string_agg(bucket||{_DIGEST}, '' order by bucket)) as root_hash from b"""


@registry.add("f1_content_id", f"select o_orderkey, sha256({encoded(*_marked(ORDER_COLUMNS))}) as id from orders")
def f1(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", content_id(orders, ORDER_COLUMNS).alias("id"))


@registry.add("a8_table_hash_lineitem", _table_hash_sql("lineitem", LINE_COLUMNS))
def a8_lineitem(spark, sf):
    return table_hash(table(spark, sf, "lineitem"), LINE_COLUMNS)


@registry.add("a8_table_hash_orders", _table_hash_sql("orders", ORDER_COLUMNS))
def a8_orders(spark, sf):
    return table_hash(table(spark, sf, "orders"), ORDER_COLUMNS)


@registry.add(
    "a8_bucket_hashes",
    f"""with h as (select sha256({encoded(*_marked(ORDER_COLUMNS))}) h, sha256({encoded("o_orderkey")}) kh from orders),
    b as (select substr(kh,1,2) bucket, count(*) n, {_LANES} from h group by 1)
    select bucket, n as row_count, {_DIGEST} as digest from b""",
)
def a8_buckets(spark, sf):
    return bucket_hashes(table(spark, sf, "orders"), ORDER_COLUMNS, ["o_orderkey"])


_GROUP_SQL = f"""h as (select l_orderkey, sha256({encoded("l_linenumber", "l_returnflag$", "l_linestatus$")}) h from lineitem),
    g as (select l_orderkey, count(*) n, {_LANES} from h group by 1), o as (select l_orderkey, n, {_DIGEST} as order_hash from g)"""


@registry.add("a9_group_hash", f"with {_GROUP_SQL} select l_orderkey, n as row_count, order_hash from o")
def a9(spark, sf):
    return group_hash(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_returnflag", "l_linestatus"], "order")


@registry.add("a9_equal_groups", f"with {_GROUP_SQL} select order_hash, count(*) as orders, min(l_orderkey) as first_order from o group by 1")
def a9_equal(spark, sf):
    hashes = a9(spark, sf)
    return hashes.groupBy("order_hash").agg(F.count(F.lit(1)).alias("orders"), F.min("l_orderkey").alias("first_order"))


# --- whole schemas ------------------------------------------------------------------------------


def _list_text(column: str) -> str:
    return f"case when len({column}) > 0 then len({column})::varchar||'['||array_to_string(list_transform({column}, lambda x: strlen(x)::varchar||':'||x), '')||']' end"


def _group_digest(name: str, parent: str, fields: tuple[str, ...], source: str) -> str:
    return f"""{name}_h as (select {parent}, sha256({encoded(*fields)}) h from ({source})), {name}_g as (select {parent}, count(*) n, {_LANES} from {name}_h group by {parent}),
{name}_d as (select {parent}, {_DIGEST} d from {name}_g)"""


_SCHEMA_SQL = ",\n".join(
    (
        CATALOG_SQL,
        _group_digest("col", "ns_oid, relname", ("id$", "attname$", "type_name$", "nullable", "d$", "ident", "gen$"), "select *, 'col:'||ns_oid::varchar||'.'||attname id, not not_null nullable, nullif(expression, '') d, case when identity <> '' then true end ident, nullif(generated_kind, '') gen from columns"),
        _group_digest("con", "ns_oid", ("id$", "conname$", "contype$", "c$", "e$", "referenced_table$", "r$"), f"select *, 'con:'||ns_oid::varchar||'.'||conname id, {_list_text('columns')} c, null e, {_list_text('referenced_columns')} r from constraints"),
        _group_digest("idx", "ns_oid, tablename", ("id$", "relname$", "c$", "m$", "u", "predicate$"), f"select *, 'idx:'||ns_oid::varchar||'.'||relname id, {_list_text('columns')} c, 'btree' m, case when is_unique then true end u from indexes"),
        _group_digest("vw", "ns_oid", ("id$", "relname$", "definition$", "null$"), "select *, 'view:'||ns_oid::varchar||'.'||relname id from views"),
        _group_digest("seq", "ns_oid", ("id$", "seqname$", "data_type$", '"start"', "increment", "min_value", "max_value", "cycle"), "select *, 'seq:'||ns_oid::varchar||'.'||seqname id from sequences"),
        f"""tab as (select distinct c.ns_oid, c.relname, 'tbl:'||c.ns_oid::varchar||'.'||c.relname id, a.d a, b.d b, i.d i from columns c left join col_d a on a.ns_oid=c.ns_oid and a.relname=c.relname
  left join con_d b on b.ns_oid=c.ns_oid left join idx_d i on i.ns_oid=c.ns_oid and i.tablename=c.relname),
tab_node as (select ns_oid, relname, id, sha256({encoded("id$", "relname$", "a$", "b$", "i$")}) hash from tab)""",
        _group_digest("tn", "ns_oid", ("id$", "hash$"), "select * from tab_node"),
        f"""ns as (select n.ns_oid, n.ns_oid::varchar nspname, 'ns:'||n.ns_oid::varchar id, t.d t, v.d v, s.d s from namespaces n left join tn_d t using (ns_oid) left join vw_d v using (ns_oid) left join seq_d s using (ns_oid)),
ns_node as (select nspname, id, sha256({encoded("id$", "nspname$", "t$", "v$", "null$", "s$", "null$")}) hash from ns)""",
    )
)


def _schema_nodes(spark, sf):
    """Hashes of tables and namespaces of the derived catalog, named by number."""
    found = catalog(spark, sf)
    ns = F.col("ns_oid").cast("string")

    def member(df, kind, name, **fields):
        return df.select(ns.alias("nspname"), F.concat(F.lit(f"{kind}:"), ns, F.lit("."), F.col(name)).alias("id"), F.col(name).alias("name"), *[v.alias(k) for k, v in fields.items()])

    col = F.col
    columns = member(found["columns"], "col", "attname", relname=col("relname"), type=col("type_name"), nullable=~col("not_null"), default=col("expression"), is_identity=col("identity") != "", generated=col("generated_kind"))
    constraints = member(found["constraints"], "con", "conname", relname=F.lit("users"), type=col("contype"), columns=col("columns"), referenced_table=col("referenced_table"), referenced_columns=col("referenced_columns"))
    indexes = member(found["indexes"], "idx", "relname", relname=col("tablename"), columns=col("columns"), method=F.lit("btree"), unique=col("is_unique"), predicate=col("predicate"))
    tables = found["columns"].select(ns.alias("nspname"), "relname").distinct().select("nspname", "relname", F.concat(F.lit("tbl:"), "nspname", F.lit("."), "relname").alias("id"), col("relname").alias("name"))
    views = member(found["views"], "view", "relname", definition=col("definition"))
    sequences = member(found["sequences"], "seq", "seqname", **{c: col(c) for c in ("data_type", "start", "increment", "min_value", "max_value", "cycle")})
    nodes = table_hashes(tables, columns=columns, constraints=constraints, indexes=indexes)
    namespaces = found["namespaces"].select(ns.alias("nspname"), F.concat(F.lit("ns:"), ns).alias("id"))
    return nodes, namespace_hashes(namespaces, nodes, views=views, sequences=sequences)


@registry.add("a3_table_hashes", f"with {_SCHEMA_SQL} select id, hash from tab_node")
def a3_table_hashes(spark, sf):
    return _schema_nodes(spark, sf)[0].select("id", "hash")


@registry.add("a3_schema_hash", f"""with {_SCHEMA_SQL}, {_group_digest("all", "one", ("id$", "hash$"), "select 1 one, * from ns_node")} select (select count(*) from ns_node) as namespaces, d as hash from all_d""")
def a3_schema_hash(spark, sf):
    """The whole catalog as one schema."""
    return schema_hash(_schema_nodes(spark, sf)[1])


# --- names --------------------------------------------------------------------------------------

_HASHY = "case doc_id%4 when 0 then sha256(text) when 1 then upper(sha256(text)) when 2 then substr(sha256(text),1,63) else sha256(text)||'0' end"


@registry.add("f2_is_hash", f"select doc_id, regexp_matches({_HASHY}, '^[0-9a-f]{{64}}$') as valid from documents")
def f2(spark, sf):
    sha = F.sha2("text", 256)
    value = F.expr("doc_id % 4")
    made = F.when(value == 0, sha).when(value == 1, F.upper(sha)).when(value == 2, F.substring(sha, 1, 63)).otherwise(F.concat(sha, F.lit("0")))
    return table(spark, sf, "documents").select("doc_id", is_hash(made).alias("valid"))


REF_FORMS = ("refs/heads/{}", "refs/tags/{}", "refs/{}", "refs/heads/{}/", "refs/heads//{}", "refs/heads/../{}", "refs/heads/./{}", "refs/heads/a/{}", "refs\\\\heads/{}", "refs/tags/{}/.")


def _forms_sql(value: str) -> str:
    return "union all ".join(f"select page_id, replace('{form.replace(chr(92) * 2, chr(92))}', '{{}}', {value}) ref from pages " for form in REF_FORMS)


@registry.add(
    "f3_is_ref",
    f"""select page_id, ref, (starts_with(ref, 'refs/heads/') or starts_with(ref, 'refs/tags/')) and not contains(ref, chr(92)) and not contains(ref, '..')
       and not contains(ref, '//') and not ends_with(ref, '/') and not contains(ref, '/./') and not ends_with(ref, '/.') and ref <> 'refs/heads/' as valid
    from ({_forms_sql("split_part(split_part(url, '//', 2), '/', 1)")})""",
)
def f3(spark, sf):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    forms = F.array(*[F.lit(f.replace("\\\\", "\\")) for f in REF_FORMS])
    refs = table(spark, sf, "pages").select("page_id", F.explode(F.transform(forms, lambda f: F.replace(f, F.lit("{}"), host))).alias("ref"))
    return refs.select("page_id", "ref", is_ref(F.col("ref")).alias("valid"))


@registry.add(
    "f6_unqualify",
    """select p_partkey, case when contains(n, '.') then regexp_extract(n, '([^.]*)$', 1) else n end as name
    from (select p_partkey, trim(trim(p_brand||'.'||p_type||case when p_partkey%3=0 then '."'||p_name||'" ' else '' end, ' '), '"') n from part)""",
)
def f6(spark, sf):
    written = F.concat("p_brand", F.lit("."), "p_type", F.expr("case when p_partkey % 3 = 0 then concat('.\"', p_name, '\" ') else '' end"))
    # A quote before the last component is inside the name and stays.
    return table(spark, sf, "part").select("p_partkey", unqualify(written).alias("name"))


@registry.add("f7_safe_name", "select page_id, regexp_replace(url, '[:/\\\\ ]|\\.\\.', '_', 'g') as name from pages")
def f7(spark, sf):
    return table(spark, sf, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


_IDS_SQL = """ids as (select 'tbl:'||c_mktsegment||'/'||c_nationkey::varchar id from customer union select 'tbl/'||c_mktsegment||':'||c_nationkey::varchar from customer where c_nationkey > 12)"""


@registry.add(
    "f7_collisions",
    f"""with {_IDS_SQL} select regexp_replace(id, '[:/\\\\ ]|\\.\\.', '_', 'g') as safe_name, count(*) as ids, min(id) as first_id, max(id) as last_id
    from ids group by 1 having count(*) > 1""",
)
def f7_collisions(spark, sf):
    customer = table(spark, sf, "customer")
    nation = F.col("c_nationkey").cast("string")
    one = customer.select(F.concat(F.lit("tbl:"), "c_mktsegment", F.lit("/"), nation).alias("id"))
    two = customer.filter("c_nationkey > 12").select(F.concat(F.lit("tbl/"), "c_mktsegment", F.lit(":"), nation).alias("id"))
    return name_collisions(one.unionByName(two), "id", safe_name(F.col("id")))


REFUSED = ("\\", "copy ", "create database", "drop database", "the", "la", "die", "le ")


def _screen_sql() -> str:
    cases = []
    for word in REFUSED:
        quoted = word.replace("\\", "\\\\")
        boundary = "([^A-Za-z0-9_]|$)" if word[-1].isalnum() else ""
        cases.append(f"when regexp_matches(text, '^\\s*(?i:{quoted}){boundary}') then '{word.strip()}'")
    return f"select doc_id, case when regexp_matches(text, '^\\s*$') then 'empty' {' '.join(cases)} end as problem from documents"


@registry.add("f8_screen_text", _screen_sql())
def f8(spark, sf):
    return screen_text(table(spark, sf, "documents"), "text", REFUSED).select("doc_id", "problem")


@registry.add(
    "f9_collapse_space",
    """select doc_id, sha256(one) as whole, case when length(one) > 60 then substr(one,1,60)||'...' else one end as short
    from (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') one from documents)""",
)
def f9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(collapse_space(F.col("text")), 256).alias("whole"), collapse_space(F.col("text"), 60).alias("short"))


# Commas split everywhere except in the modifiers, which the test lists keep in brackets.
@registry.add(
    "f10_split_top_level",
    """select p_partkey, row_number() over (partition by p_partkey order by i) as ordinal, trim(a) as argument
    from (select p_partkey, unnest([p_name, 'numeric('||p_size::varchar||', 2)', p_type||'[1, 2]', 'f(a, (b, c))']) a, unnest([1,2,3,4]) i from part)""",
)
def f10(spark, sf):
    arguments = F.concat("p_name", F.lit(", numeric("), F.col("p_size").cast("string"), F.lit(", 2), "), "p_type", F.lit("[1, 2],f(a, (b, c))"))
    return split_arguments(table(spark, sf, "part").withColumn("arguments", arguments), ["p_partkey"], "arguments").withColumn(
        "ordinal", F.col("ordinal").cast("bigint")
    )


_TYPES_SQL = """live as (select n.nspname, c.* from columns c join namespaces n using (ns_oid)),
forms(type_name, normal) as (values ('bigint','int8'), ('character varying(255)','varchar(255)'), ('public.user_role','user_role'),
  ('numeric(10, 2)','numeric(10,2)'), ('timestamp with time zone[]','timestamptz[]'), ('text','text'))"""


@registry.add(
    "f4_normalise_types",
    f"""with {CATALOG_SQL}, {_TYPES_SQL} select ns_oid, attname, normal as normal_type, case normal when 'int8' then 'bigint' when 'varchar(255)' then 'character varying(255)'
      when 'timestamptz[]' then 'timestamp with time zone[]' else normal end as shown from live join forms using (type_name)""",
)
def f4(spark, sf):
    columns = normalise_types(catalog(spark, sf)["columns"], "type_name", "catalog")
    return normalise_types(columns, "normal_type", "display", "shown").select("ns_oid", "attname", "normal_type", "shown")


@registry.add(
    "f4_malformed_types",
    """select p_partkey, case when p_partkey%2=0 then 'numeric('||p_size::varchar||',2)[]' end as normal_type,
       case when p_partkey%2=1 then 'malformed type: decimal( '||p_size::varchar||', 2' end as type_error from part""",
)
def f4_malformed(spark, sf):
    closing = F.expr("case when p_partkey % 2 = 0 then ' ) [] ' else '' end")
    written = F.concat(F.lit("decimal( "), F.col("p_size").cast("string"), F.lit(", 2"), closing)
    parts = table(spark, sf, "part").withColumn("written", written)
    return normalise_types(parts, "written", "ddl").select("p_partkey", "normal_type", "type_error")


@registry.add(
    "f5_type_parts",
    f"""with {CATALOG_SQL}, {_TYPES_SQL} select ns_oid, attname, regexp_extract(normal, '^([^(\\[]*)', 1) as type_base, case when normal like '%)' then regexp_extract(normal, '(\\(.*\\))', 1) else '' end as type_modifiers,
      contains(normal, '[]') as is_array, case when contains(normal, '[]') then replace(normal, '[]', '') end as element_type, replace(normal, '[]', '')||'[]' as array_of,
      regexp_extract(normal, '^([^(\\[]*)', 1) in ('int8','varchar','numeric','timestamptz','text') as is_builtin from live join forms using (type_name)""",
)
def f5(spark, sf):
    columns = catalog(spark, sf)["columns"].withColumn("normal", normal_type(F.col("type_name"), "catalog"))
    return type_parts(columns, "normal").select("ns_oid", "attname", "type_base", "type_modifiers", "is_array", "element_type", "array_of", "is_builtin")


@registry.add(
    "p7_default_namespace",
    "select c_custkey, case when c_custkey%3=0 then 'public' when c_custkey%3=1 then 'public' else c_mktsegment end as namespace from customer",
)
def p7(spark, sf):
    given = F.expr("case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else c_mktsegment end")
    return table(spark, sf, "customer").select("c_custkey", default_namespace(given).alias("namespace"))


@registry.add(
    "p8_object_id",
    f"""with {CATALOG_SQL} select 'col:'||nspname||'.'||relname||'.'||attname as id, 'tbl:'||nspname||'.'||relname as parent_id, 'ns:'||nspname as namespace_id
    from columns join namespaces using (ns_oid)""",
)
def p8(spark, sf):
    found = catalog(spark, sf)
    columns = found["columns"].join(found["namespaces"], "ns_oid")
    ns, rel = F.col("nspname"), F.col("relname")
    return columns.select(
        object_id("column", ns, rel, F.col("attname")).alias("id"), object_id("table", ns, rel).alias("parent_id"), object_id("namespace", ns).alias("namespace_id")
    )


@registry.add(
    "p9_empty_as_absent",
    f"""with {CATALOG_SQL} select ns_oid, attname, nullif(identity,'') as identity, nullif(generated_kind,'') as generated_kind,
      nullif(expression,'') as expression, case when not_null then true end as not_null, attname||':' as keys from columns""",
)
def p9(spark, sf):
    columns = catalog(spark, sf)["columns"].withColumn("keys", F.lit(None).cast("array<string>"))
    filled = empty_as_absent(columns, ["identity", "generated_kind", "expression", "not_null"], ["keys"])
    return filled.select("ns_oid", "attname", "identity", "generated_kind", "expression", "not_null", F.concat("attname", F.lit(":"), F.array_join("keys", ",")).alias("keys"))
