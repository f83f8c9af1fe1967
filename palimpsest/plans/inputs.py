"""Test tables and the relations derived from them, for Spark and as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.session import dealt, durable, large, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL of the same result where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, inside the session's checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def encoded(*columns: str) -> str:
    """SQL of the row encoding; texts and lists are marked with a trailing `$`."""
    pieces = []
    for column in columns:
        if column.endswith("$"):
            text = f"({column[:-1]})::varchar"
            pieces.append(f"coalesce(strlen({text})::varchar, 'N') || ':' || coalesce({text}, '')")
        else:
            pieces.append(f"coalesce(({column})::varchar, 'N') || ';'")
    return " || ".join(pieces)


# --- versions of orders -------------------------------------------------------------------------

VERSIONS_SQL = """
base as (select o_orderkey k, o_orderstatus s, o_totalprice p, o_orderpriority r from orders),
ours as (
  select o_orderkey k, case when o_orderkey%10=3 then 'X' else o_orderstatus end s,
         case when o_orderkey%7=0 then o_totalprice+1.0 else o_totalprice end p, o_orderpriority r
  from orders where o_orderkey%97<>0
  union all select o_orderkey+1000000000, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderkey%50=0),
theirs as (
  select o_orderkey k, case when o_orderkey%15=3 then 'Y' else o_orderstatus end s, o_totalprice p,
         case when o_orderkey%11=0 then 'ZZ' else o_orderpriority end r
  from orders where o_orderkey%89<>0
  union all select o_orderkey+1000000000, o_orderstatus,
         o_totalprice + case when o_orderkey%100=0 then 2.0 else 0.0 end, o_orderpriority from orders where o_orderkey%50=0)
"""


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, ours and theirs of the orders table: k, s, p, r."""
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    base = orders.select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("r"))
    late = base.filter("k % 50 = 0").withColumn("k", F.col("k") + 1_000_000_000)
    ours = (
        base.filter("k % 97 <> 0")
        .withColumns({"s": F.expr("case when k % 10 = 3 then 'X' else s end"), "p": F.expr("case when k % 7 = 0 then p + 1.0D else p end")})
        .unionByName(late)
    )
    theirs = (
        base.filter("k % 89 <> 0")
        .withColumns({"s": F.expr("case when k % 15 = 3 then 'Y' else s end"), "r": F.expr("case when k % 11 = 0 then 'ZZ' else r end")})
        .unionByName(late.withColumn("p", F.expr("p + case when (k - 1000000000) % 100 = 0 then 2.0D else 0.0D end")))
    )
    return base, ours, theirs


# --- one repository per customer ----------------------------------------------------------------

HISTORY_SQL = """
s as (select o_custkey repo_id, o_orderkey, sha256('c|'||o_orderkey::varchar) sha, o_orderdate ts,
       row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)-1 seq,
       count(*) over (partition by o_custkey) n from orders),
commits as (select repo_id, sha, ts from s),
edges as (
  select a.repo_id, a.sha child, 0 idx, b.sha parent from s a join s b
    on a.repo_id=b.repo_id and b.seq=greatest(a.seq-2,0) and a.seq>=1 where a.o_orderkey%31<>0
  union all
  select a.repo_id, a.sha, 1, b.sha from s a join s b on a.repo_id=b.repo_id and b.seq=a.seq-1
  where a.seq>=3 and a.o_orderkey%5=0 and a.o_orderkey%31<>0),
refs as (
  select repo_id, 'refs/heads/main' "full", sha from s where seq=n-1
  union all select repo_id, 'refs/heads/alt', sha from s where seq=n-1 and repo_id%3=0
  union all select repo_id, 'refs/heads/dev', sha from s where seq=n-2
  union all select repo_id, 'refs/tags/v1', sha from s where seq=0
  union all select repo_id, 'refs/tags/v0', sha from s where seq=0 and repo_id%4=0
  union all select repo_id, 'refs/heads/dangling', sha256('none|'||repo_id::varchar) from s where seq=0 and repo_id%40=0),
heads as (
  select repo_id, case when repo_id%10=0 then null when repo_id%25=1 then 'refs/heads/none' else 'refs/heads/main' end ref,
       case when repo_id%10=0 then sha end sha from s where seq=0),
lasts as (select repo_id, sha start from s where seq=n-1),
befores as (select repo_id, sha start from s where seq=n-2),
starts as (select * from lasts union all select * from befores),
paths(repo_id, start, sha, depth, path) as (
  select repo_id, start, start, 0, '' from starts
  union all
  select w.repo_id, w.start, e.parent, w.depth+1, w.path || lpad(e.idx::varchar, 3, '0')
  from paths w join edges e on e.repo_id=w.repo_id and e.child=w.sha),
walked as (select repo_id, start, sha, depth, path from (
  select *, row_number() over (partition by repo_id, start, sha order by depth, path) pick from paths) where pick=1),
ranked as (select *, row_number() over (partition by repo_id, start order by depth, path) rank from walked),
labels as (select repo_id, sha, coalesce(max(case when "full" like 'refs/heads/%' then "full" end),
       min(case when "full" like 'refs/tags/%' then "full" end)) ref from refs group by 1, 2)
"""


def commit_sha(key: Column) -> Column:
    """The name of the commit made of an order."""
    return F.sha2(F.concat(F.lit("c|"), key.cast("string")), 256)


def history(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """commits, edges (links: by order keys), refs, heads and the last and last-but-one commit per repository."""
    orders = table(spark, sf, "orders")
    # Positions within a customer come from ranking the orders; a customer with very many orders
    # is ranked over many tasks.
    from palimpsest.operators.groups import rank_in_group

    numbered = rank_in_group(
        orders.select(F.col("o_custkey").alias("repo_id"), "o_orderkey", F.col("o_orderdate").alias("ts")), ["repo_id"], ["ts", "o_orderkey"], "seq"
    )
    counted = orders.groupBy(F.col("o_custkey").alias("repo_id")).agg(F.count(F.lit(1)).alias("n"))
    keyed = durable(numbered.join(counted, "repo_id").select("repo_id", "o_orderkey", "ts", (F.col("seq") - 1).alias("seq"), "n"))
    s = keyed.select("repo_id", "o_orderkey", commit_sha(F.col("o_orderkey")).alias("sha"), "ts", "seq", "n")
    # Orders meet by their keys; the names, eight times as long, are made of them afterwards.
    at = keyed.select("repo_id", F.col("seq").alias("pseq"), F.col("o_orderkey").alias("parent"))
    wanted = keyed.filter("seq >= 1 and o_orderkey % 31 <> 0").withColumnRenamed("o_orderkey", "child")
    first = wanted.select("repo_id", "child", F.lit(0).alias("idx"), F.greatest(F.col("seq") - 2, F.lit(0)).alias("pseq"))
    second = wanted.filter("seq >= 3 and child % 5 = 0").select("repo_id", "child", F.lit(1).alias("idx"), (F.col("seq") - 1).alias("pseq"))
    links = first.unionByName(second).join(large(at, ["repo_id", "pseq"]), ["repo_id", "pseq"], "inner").select("repo_id", "child", "idx", "parent")
    edges = links.select("repo_id", commit_sha(F.col("child")).alias("child"), "idx", commit_sha(F.col("parent")).alias("parent"))

    def ref(rows: DataFrame, full: str) -> DataFrame:
        return rows.select("repo_id", F.lit(full).alias("full"), "sha")

    last, root = s.filter("seq = n - 1"), s.filter("seq = 0")
    none = root.filter("repo_id % 40 = 0").withColumn("sha", F.sha2(F.concat(F.lit("none|"), F.col("repo_id").cast("string")), 256))
    refs = (
        ref(last, "refs/heads/main")
        .unionByName(ref(last.filter("repo_id % 3 = 0"), "refs/heads/alt"))
        .unionByName(ref(s.filter("seq = n - 2"), "refs/heads/dev"))
        .unionByName(ref(root, "refs/tags/v1"))
        .unionByName(ref(root.filter("repo_id % 4 = 0"), "refs/tags/v0"))
        .unionByName(ref(none, "refs/heads/dangling"))
    )
    heads = root.select(
        "repo_id",
        F.expr("case when repo_id % 10 = 0 then null when repo_id % 25 = 1 then 'refs/heads/none' else 'refs/heads/main' end").alias("ref"),
        F.expr("case when repo_id % 10 = 0 then sha end").alias("sha"),
    )
    lasts = last.select("repo_id", F.col("sha").alias("start"))
    befores = s.filter("seq = n - 2").select("repo_id", F.col("sha").alias("start"))
    return {
        "commits": s.select("repo_id", "sha", "ts"),
        "edges": edges,
        "links": links,
        "refs": refs,
        "heads": heads,
        "lasts": lasts,
        "befores": befores,
        "starts": lasts.unionByName(befores),
        "numbered": s,
    }


# --- one namespace per customer -----------------------------------------------------------------

CATALOG_SQL = """
namespaces as (select c_custkey ns_oid, case when c_custkey%50=0 then 'pg_'||c_custkey::varchar
       when c_custkey%50=1 then 'pgx'||c_custkey::varchar
       when c_custkey=2 then 'information_schema' else 'ns'||c_custkey::varchar end nspname from customer),
columns as (select c_custkey ns_oid, 'users' relname, v.* from customer,
 (values ('id', 1, 'bigint', true, '', '', 'nextval(''public.user_id_seq''::regclass)', false),
         ('email', 4, 'character varying(255)', true, '', '', '''unknown''::text', false),
         ('role', 7, 'public.user_role', true, '', '', null, false),
         ('score', 9, 'numeric(10, 2)', false, '', 's', 'a + b', false),
         ('seen', 11, 'timestamp with time zone[]', false, '', '', null, false),
         ('gone', 5, 'text', false, '', '', null, true))
 v(attname, attnum, type_name, not_null, identity, generated_kind, expression, is_dropped)),
views as (select c_custkey ns_oid, v.* from customer,
 (values ('active', 'SELECT id, email FROM public.users WHERE (email <> ''''::text);'),
         ('recent', 'select id from active'), ('constant', 'select 1'), ('broken', 'select id from missing'))
 v(relname, definition)),
sequences as (select c_custkey ns_oid, v.* from customer,
 (values ('user_id_seq','int8',1,1,1,9223372036854775807,false), ('counter','int4',5,2,5,100,true),
         ('bad_type','float4',1,1,1,10,false), ('bad_step','int8',1,0,1,10,false))
 v(seqname, data_type, start, increment, min_value, max_value, cycle)),
enums as (select c_custkey ns_oid, v.* from customer,
 (values ('user_role',2.0,'member'),('user_role',1.0,'admin')) v(typname, sortorder, label)),
indexes as (select c_custkey ns_oid, v.* from customer,
 (values ('users_email_idx','users',['email'],false,null), ('users_seen_idx','users',['seen'],true,'(seen IS NOT NULL)'),
         ('bad_col_idx','users',['nope'],false,null), ('bad_tbl_idx','missing',['id'],false,null))
 v(relname, tablename, columns, is_unique, predicate)),
constraints as (select c_custkey ns_oid, v.* from customer,
 (values ('two_pk_a','pk',['id'],null,[]::varchar[]), ('two_pk_b','pk',['id'],null,[]::varchar[]),
         ('bad_col','unique',['missing'],null,[]::varchar[]), ('bad_kind','exclude',['id'],null,[]::varchar[]),
         ('bad_arity','fk',['id','email'],'public.other',['id']), ('no_target','fk',['id'],null,['id']))
 v(conname, contype, columns, referenced_table, referenced_columns))
"""


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    """The owner of each namespace, dealt out before rows are made of it: all relations of a catalog lie together by owner."""
    return dealt(table(spark, sf, "customer").select(F.col("c_custkey").alias("ns_oid")), ["ns_oid"])


def _per_customer(spark: SparkSession, sf: str, names: str, *rows: str) -> DataFrame:
    """Fixed rows per customer; `names` are the columns and each row is SQL of its values."""
    columns = names.split()
    structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(columns, row.split(" ; "))) + ")" for row in rows)
    return _owners(spark, sf).select("ns_oid", F.expr(f"inline(array({structs}))"))


def catalog(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Extracted catalog relations, one namespace per customer."""
    no_text, no_list = "cast(null as string)", "cast(array() as array<string>)"
    return {
        "namespaces": _owners(spark, sf)
        .select(
            "ns_oid",
            F.expr(
                "case when ns_oid % 50 = 0 then concat('pg_', ns_oid) when ns_oid % 50 = 1 then concat('pgx', ns_oid) "
                "when ns_oid = 2 then 'information_schema' else concat('ns', ns_oid) end"
            ).alias("nspname"),
        )
        .hint("merge"),
        "columns": _per_customer(
            spark, sf, "relname attname attnum type_name not_null identity generated_kind expression is_dropped",
            "'users' ; 'id' ; 1 ; 'bigint' ; true ; '' ; '' ; \"nextval('public.user_id_seq'::regclass)\" ; false",
            "'users' ; 'email' ; 4 ; 'character varying(255)' ; true ; '' ; '' ; \"'unknown'::text\" ; false",
            f"'users' ; 'role' ; 7 ; 'public.user_role' ; true ; '' ; '' ; {no_text} ; false",
            "'users' ; 'score' ; 9 ; 'numeric(10, 2)' ; false ; '' ; 's' ; 'a + b' ; false",
            f"'users' ; 'seen' ; 11 ; 'timestamp with time zone[]' ; false ; '' ; '' ; {no_text} ; false",
            f"'users' ; 'gone' ; 5 ; 'text' ; false ; '' ; '' ; {no_text} ; true",
        ),
        "views": _per_customer(
            spark, sf, "relname definition",
            "'active' ; \"SELECT id, email FROM public.users WHERE (email <> ''::text);\"",
            "'recent' ; 'select id from active'",
            "'constant' ; 'select 1'",
            "'broken' ; 'select id from missing'",
        ),
        "sequences": _per_customer(
            spark, sf, "seqname data_type start increment min_value max_value cycle",
            "'user_id_seq' ; 'int8' ; 1L ; 1L ; 1L ; 9223372036854775807L ; false",
            "'counter' ; 'int4' ; 5L ; 2L ; 5L ; 100L ; true",
            "'bad_type' ; 'float4' ; 1L ; 1L ; 1L ; 10L ; false",
            "'bad_step' ; 'int8' ; 1L ; 0L ; 1L ; 10L ; false",
        ),
        "enums": _per_customer(spark, sf, "typname sortorder label", "'user_role' ; 2.0D ; 'member'", "'user_role' ; 1.0D ; 'admin'"),
        "indexes": _per_customer(
            spark, sf, "relname tablename columns is_unique predicate",
            f"'users_email_idx' ; 'users' ; array('email') ; false ; {no_text}",
            "'users_seen_idx' ; 'users' ; array('seen') ; true ; '(seen IS NOT NULL)'",
            f"'bad_col_idx' ; 'users' ; array('nope') ; false ; {no_text}",
            f"'bad_tbl_idx' ; 'missing' ; array('id') ; false ; {no_text}",
        ),
        "constraints": _per_customer(
            spark, sf, "conname contype columns referenced_table referenced_columns",
            f"'two_pk_a' ; 'pk' ; array('id') ; {no_text} ; {no_list}",
            f"'two_pk_b' ; 'pk' ; array('id') ; {no_text} ; {no_list}",
            f"'bad_col' ; 'unique' ; array('missing') ; {no_text} ; {no_list}",
            f"'bad_kind' ; 'exclude' ; array('id') ; {no_text} ; {no_list}",
            "'bad_arity' ; 'fk' ; array('id', 'email') ; 'public.other' ; array('id')",
            f"'no_target' ; 'fk' ; array('id') ; {no_text} ; array('id')",
        ),
    }


# --- inputs that break a rule -------------------------------------------------------------------

BROKEN_SQL = """
cut_orders as (select * from orders where o_orderkey%20<>0),
broken_customer as (select case when c_custkey%100=0 then null else c_custkey end c_custkey,
       case when c_custkey%30=0 then '' else c_name end c_name,
       case when c_custkey%25=0 then 'UNKNOWN' else c_mktsegment end c_mktsegment, c_custkey row_id from customer),
tampered as (select doc_id, sha256(text) stored, case when doc_id%40=0 then text||'!' else text end text from documents),
broken_events as (select event_id, case when event_id%50=0 then replace(props,'}',', "extra": 1}')
       when event_id%50=1 then props||' x' when event_id%50=2 then '{' else props end props from events),
stored_migrations as (select sha256(doc_id::varchar) migration_id, text up_sql, lang down_sql from documents),
ledger as (select sha256(doc_id::varchar) migration_id from documents where doc_id%3=0
  union all select sha256('x'||doc_id::varchar) from documents where doc_id%200=0)
"""


def broken(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Tables with orphans, nulls, empty texts, tampered content and malformed JSON."""
    documents = table(spark, sf, "documents")
    doc = F.col("doc_id").cast("string")
    return {
        "cut_orders": table(spark, sf, "orders").filter("o_orderkey % 20 <> 0"),
        "customer": table(spark, sf, "customer").select(
            F.expr("case when c_custkey % 100 = 0 then null else c_custkey end").alias("c_custkey"),
            F.expr("case when c_custkey % 30 = 0 then '' else c_name end").alias("c_name"),
            F.expr("case when c_custkey % 25 = 0 then 'UNKNOWN' else c_mktsegment end").alias("c_mktsegment"),
            F.col("c_custkey").alias("row_id"),
        ),
        "tampered": documents.select(
            "doc_id", F.sha2("text", 256).alias("stored"), F.expr("case when doc_id % 40 = 0 then concat(text, '!') else text end").alias("text")
        ),
        "events": table(spark, sf, "events").select(
            "event_id",
            F.expr(
                "case when event_id % 50 = 0 then replace(props, '}', ', \"extra\": 1}') when event_id % 50 = 1 then concat(props, ' x') "
                "when event_id % 50 = 2 then '{' else props end"
            ).alias("props"),
        ),
        "migrations": documents.select(F.sha2(doc, 256).alias("migration_id"), F.col("text").alias("up_sql"), F.col("lang").alias("down_sql")),
        "ledger": documents.filter("doc_id % 3 = 0")
        .select(F.sha2(doc, 256).alias("migration_id"))
        .unionByName(documents.filter("doc_id % 200 = 0").select(F.sha2(F.concat(F.lit("x"), doc), 256).alias("migration_id"))),
    }


def listed(column: str) -> Column:
    """A list as text, so that results compare the same everywhere."""
    return F.array_join(column, ",").alias(column)
