"""Rules over metadata rows and constraints over data rows, on clean and on broken input."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.names import object_id
from palimpsest.operators import constraints as D, rules as C
from palimpsest.operators.relational import filter_live
from palimpsest.operators.one_pass import KeyRule, RowRule, check_all
from palimpsest.plans.inputs import BROKEN_SQL, CATALOG_SQL, Registry, broken, catalog, table
from palimpsest.sources.strict_json import strict_json

registry = Registry()

_BROKEN = f"with {BROKEN_SQL}"
_CATALOG = f"with {CATALOG_SQL}"


def _row(c: str) -> str:
    return f"{c}::varchar"


# --- metadata rows ------------------------------------------------------------------------------


@registry.add(
    "c1_required",
    f"""{_BROKEN} select 'required' as rule, row_id::varchar as object_id, 'c_custkey' as field, 'missing' as detail from broken_customer where c_custkey is null
    union all select 'required', row_id::varchar, 'c_name', 'missing' from broken_customer where c_name is null""",
)
def c1(spark, sf):
    return C.required(broken(spark, sf)["customer"], F.col("row_id"), ["c_custkey", "c_name"])


@registry.add("c1_required_clean", "select 'required' as rule, c_custkey::varchar as object_id, 'c_name' as field, 'missing' as detail from customer where c_name is null or c_custkey is null")
def c1_clean(spark, sf):
    return C.required(table(spark, sf, "customer"), F.col("c_custkey"), ["c_custkey", "c_name"])


@registry.add("c2_min_length", f"{_BROKEN} select 'min_length' as rule, row_id::varchar as object_id, 'c_name' as field, 'empty' as detail from broken_customer where c_name = ''")
def c2(spark, sf):
    return C.min_length(broken(spark, sf)["customer"], F.col("row_id"), ["c_name", "c_mktsegment"])


@registry.add("c3_minimum", "select 'minimum' as rule, l_orderkey::varchar as object_id, 'l_linenumber' as field, l_linenumber::varchar as detail from lineitem where l_linenumber < 2")
def c3(spark, sf):
    return C.minimum(table(spark, sf, "lineitem"), F.col("l_orderkey"), "l_linenumber", 2)


@registry.add(
    "c4_domain",
    f"""{_BROKEN} select 'domain' as rule, row_id::varchar as object_id, 'c_mktsegment' as field, c_mktsegment as detail from broken_customer
    where c_mktsegment not in ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')""",
)
def c4(spark, sf):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return C.domain(broken(spark, sf)["customer"], F.col("row_id"), "c_mktsegment", segments)


@registry.add(
    "c4_constraint_kind",
    f"{_CATALOG} select 'domain' as rule, 'con:'||nspname||'.users.'||conname as object_id, 'contype' as field, contype as detail from constraints join namespaces using (ns_oid) where contype not in ('pk','unique','check','fk')",
)
def c4_kind(spark, sf):
    return C.domain(_constraints(spark, sf), F.col("id"), "contype")


@registry.add(
    "c5_unknown_fields",
    f"""{_BROKEN} select 'unknown_field' as rule, event_id::varchar as object_id, 'props' as field, case when json_valid(props) then 'extra' else 'malformed' end as detail
    from broken_events where not json_valid(props) or contains(props, 'extra')""",
)
def c5(spark, sf):
    found = strict_json(broken(spark, sf)["events"], "props", ["k"])
    detail = F.when(F.col("problem") == "malformed", "malformed").otherwise(F.array_join("unknown_keys", ","))
    return C.violations(found, "unknown_field", F.col("event_id"), "props", detail)


@registry.add(
    "c5_value_kinds",
    """select 'value_kind' as rule, event_id::varchar as object_id, 'k' as field, 'wrong kind' as detail from
      (select event_id, case when event_id%7=0 then '{"k": "x"}' when event_id%7=1 then '{"k": true}' else props end props from events)
      where json_type(props, '$.k') not in ('BIGINT', 'UBIGINT')""",
)
def c5_kinds(spark, sf):
    props = F.expr("""case when event_id % 7 = 0 then '{"k": "x"}' when event_id % 7 = 1 then '{"k": true}' else props end""")
    return C.value_kinds(table(spark, sf, "events").withColumn("props", props), F.col("event_id"), "props", {"k": "BIGINT"})


@registry.add(
    "c5_number_kinds",
    """select 'value_kind' as rule, event_id::varchar as object_id, case event_id%6 when 2 then 'd' when 4 then 'i' else 'props' end as field, case when event_id%6 in (2, 4) then 'wrong kind' else 'malformed' end as detail
    from events where event_id%6 in (2, 3, 4)""",
)
def c5_numbers(spark, sf):
    """Whole numbers and decimals are DOUBLEs, texts are not; 1.5 is no BIGINT; text that is no JSON is reported."""
    props = F.expr("""element_at(array('{"d": 1.5, "i": 2}', '{"d": 3, "i": null}', '{"d": "1.5"}', '{"d":', '{"i": 1.5}', '{"d": 1e3, "x": 0}'), cast(event_id % 6 as int) + 1)""")
    return C.value_kinds(table(spark, sf, "events").withColumn("props", props), F.col("event_id"), "props", {"d": "DOUBLE", "i": "BIGINT"})


@registry.add("c6_defined_twice", "select 'defined_twice' as rule, l_orderkey::varchar as object_id, 'l_orderkey' as field, count(*)::varchar as detail from lineitem group by l_orderkey having count(*) > 1")
def c6(spark, sf):
    return C.defined_twice(table(spark, sf, "lineitem"), "l_orderkey")


def _constraints(spark, sf):
    found = catalog(spark, sf)
    joined = found["constraints"].join(found["namespaces"], "ns_oid").withColumn("relname", F.lit("users"))
    return joined.withColumn("id", object_id("constraint", F.col("nspname"), F.col("relname"), F.col("conname")))


def _live(spark, sf):
    found = catalog(spark, sf)
    return filter_live(found["columns"]).join(found["namespaces"], "ns_oid")


def _indexes(spark, sf):
    found = catalog(spark, sf)
    joined = found["indexes"].join(found["namespaces"], "ns_oid").withColumnRenamed("relname", "index_name").withColumnRenamed("tablename", "relname")
    return joined.withColumn("id", object_id("index", F.col("nspname"), F.col("relname"), F.col("index_name")))


@registry.add(
    "c7_single_pk",
    f"{_CATALOG} select 'single_pk' as rule, 'tbl:'||nspname||'.users' as object_id, 'contype' as field, count(*)::varchar as detail from constraints join namespaces using (ns_oid) where contype='pk' group by nspname having count(*) > 1",
)
def c7(spark, sf):
    return C.single_pk(_constraints(spark, sf), ["nspname", "relname"], object_id("table", F.col("nspname"), F.col("relname")))


@registry.add(
    "c8_known_columns",
    f"""{_CATALOG}, named as (select nspname, 'con:'||nspname||'.users.'||conname id, 'users' t, unnest(columns) c from constraints join namespaces using (ns_oid)
      union all select nspname, 'idx:'||nspname||'.'||tablename||'.'||relname, tablename, unnest(columns) from indexes join namespaces using (ns_oid))
    select 'known_column' as rule, id as object_id, 'columns' as field, c as detail from named where t <> 'users' or c not in ('id','email','role','score','seen')""",
)
def c8(spark, sf):
    live, keys = _live(spark, sf), ["nspname", "relname"]
    return C.report(
        C.known_columns(_constraints(spark, sf), keys, F.col("id"), "columns", live, "attname"),
        C.known_columns(_indexes(spark, sf), keys, F.col("id"), "columns", live, "attname"),
    )


@registry.add("c9_known_parent", f"{_CATALOG} select 'known_parent' as rule, 'idx:'||nspname||'.missing.bad_tbl_idx' as object_id, 'relname' as field, 'missing' as detail from namespaces")
def c9(spark, sf):
    tables = _live(spark, sf).select("nspname", "relname").distinct()
    return C.known_parent(_indexes(spark, sf), ["nspname", "relname"], F.col("id"), tables)


@registry.add(
    "c10_fk_arity",
    f"{_CATALOG} select 'fk_arity' as rule, 'con:'||nspname||'.users.'||conname as object_id, 'columns' as field, len(columns)::varchar||':'||len(referenced_columns)::varchar as detail from constraints join namespaces using (ns_oid) where contype='fk' and len(columns) <> len(referenced_columns)",
)
def c10(spark, sf):
    return C.fk_arity(_constraints(spark, sf), F.col("id"), "columns", "referenced_columns")


@registry.add("c11_fk_target", f"{_CATALOG} select 'fk_target' as rule, 'con:'||nspname||'.users.'||conname as object_id, 'referenced_table' as field, 'missing' as detail from constraints join namespaces using (ns_oid) where contype='fk' and referenced_table is null")
def c11(spark, sf):
    return C.fk_target(_constraints(spark, sf), F.col("id"), "referenced_table")


@registry.add(
    "c12_has_members",
    """select 'has_members' as rule, o_orderkey::varchar as object_id, 'lines' as field, 'none' as detail from orders where o_orderkey not in (select l_orderkey from lineitem)
    union all select 'has_members', c_custkey::varchar, 'orders', 'none' from customer where c_custkey not in (select o_custkey from orders)""",
)
def c12(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.report(
        C.has_members(table(spark, sf, "orders"), ["o_orderkey"], F.col("o_orderkey"), lines, "lines"),
        C.has_members(table(spark, sf, "customer"), ["c_custkey"], F.col("c_custkey"), orders, "orders"),
    )


@registry.add(
    "c13_sequences",
    f"""{_CATALOG} select 'sequence' as rule, 'seq:'||nspname||'.bad_type' as object_id, 'data_type' as field, 'unsupported' as detail from namespaces
    union all select 'sequence', 'seq:'||nspname||'.bad_step', 'increment', 'unsupported' from namespaces""",
)
def c13(spark, sf):
    found = catalog(spark, sf)
    sequences = found["sequences"].join(found["namespaces"], "ns_oid")
    return C.sequence_rules(sequences, object_id("sequence", F.col("nspname"), F.col("seqname")))


@registry.add(
    "c13_sequence_bounds",
    f"""{_CATALOG} select ns_oid, seqname, case when data_type='float4' then null else 1 end as low, case data_type when 'int8' then 9223372036854775807 when 'int4' then 2147483647 end as high from sequences""",
)
def c13_bounds(spark, sf):
    unset = catalog(spark, sf)["sequences"].withColumns({"min_value": F.lit(None).cast("bigint"), "max_value": F.lit(None).cast("bigint")})
    return C.with_sequence_bounds(unset).select("ns_oid", "seqname", F.col("min_value").alias("low"), F.col("max_value").alias("high"))


# --- data rows ----------------------------------------------------------------------------------


@registry.add("d1_check_pk", "select l_orderkey, l_linenumber, count(*) as times, 'repeated key' as rule from lineitem group by 1, 2 having count(*) > 1")
def d1(spark, sf):
    return D.check_pk(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@registry.add("d1_check_pk_clean", "select o_orderkey, count(*) as times, 'repeated key' as rule from orders group by 1 having count(*) > 1")
def d1_clean(spark, sf):
    return D.check_pk(table(spark, sf, "orders"), ["o_orderkey"])


@registry.add("d1_check_pk_nulls", f"{_BROKEN} select c_custkey, count(*) as times, 'null key' as rule from broken_customer where c_custkey is null group by 1")
def d1_nulls(spark, sf):
    return D.check_pk(broken(spark, sf)["customer"], ["c_custkey"])


@registry.add("d2_check_unique", f"{_BROKEN} select c_name, count(*) as times from broken_customer where c_name is not null group by 1 having count(*) > 1")
def d2(spark, sf):
    return D.check_unique(broken(spark, sf)["customer"], ["c_name"])


@registry.add("d2_check_unique_nulls", f"{_BROKEN} select c_custkey, c_mktsegment, count(*) as times from broken_customer where c_custkey is not null group by 1, 2 having count(*) > 1")
def d2_nulls(spark, sf):
    return D.check_unique(broken(spark, sf)["customer"], ["c_custkey", "c_mktsegment"])


@registry.add("d3_check_expr", "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where not (case when l_tax = 0 then null else l_discount < 0.08 or l_quantity < 30 end)")
def d3(spark, sf):
    bad = D.check_expr(table(spark, sf, "lineitem"), "case when l_tax = 0 then null else l_discount < 0.08D or l_quantity < 30 end")
    return bad.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@registry.add("d4_check_fk", f"{_BROKEN} select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey is not null and l_orderkey not in (select o_orderkey from cut_orders)")
def d4(spark, sf):
    found = D.check_fk(table(spark, sf, "lineitem"), ["l_orderkey"], broken(spark, sf)["cut_orders"], ["o_orderkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


@registry.add("d4_check_fk_clean", "select l_orderkey, l_linenumber from lineitem where l_orderkey is not null and l_orderkey not in (select o_orderkey from orders)")
def d4_clean(spark, sf):
    return D.check_fk(table(spark, sf, "lineitem"), ["l_orderkey"], table(spark, sf, "orders"), ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@registry.add(
    "d5_check_not_null",
    f"""{_BROKEN} select 'c_custkey' as field, count(*) as violations from broken_customer where c_custkey is null having count(*) > 0
    union all select 'c_name', count(*) from broken_customer where c_name is null having count(*) > 0""",
)
def d5(spark, sf):
    return D.check_not_null(broken(spark, sf)["customer"], ["c_custkey", "c_name"])


@registry.add("d6_check_enum", f"{_BROKEN} select row_id, c_mktsegment from broken_customer where c_mktsegment not in (select c_mktsegment from customer where c_mktsegment <> 'BUILDING')")
def d6(spark, sf):
    labels = table(spark, sf, "customer").select("c_mktsegment").filter("c_mktsegment <> 'BUILDING'").distinct()
    return D.check_enum(broken(spark, sf)["customer"], "c_mktsegment", labels).select("row_id", "c_mktsegment")


_ONE_PASS_SQL = f"""{_BROKEN}, c as (select * from broken_customer),
found as (select 'required' as rule, row_id::varchar object_id, 'c_custkey' field, 'missing' detail from c where c_custkey is null
  union all select 'named', row_id::varchar, 'c_name', 'empty' from c where c_name = ''
  union all select 'segment', row_id::varchar, 'c_mktsegment', c_mktsegment from c where c_mktsegment = 'UNKNOWN'
  union all select 'least', row_id::varchar, 'row_id', row_id::varchar from c where row_id < 10
  union all select 'odd', row_id::varchar, 'row_id', '' from c where row_id % 11 = 0
  union all select 'bounds', row_id::varchar, 'row_id', 'out of bounds' from c where row_id not between 3 and 100
  union all select 'own key', row_id::varchar, 'c_custkey', '' from c where c_custkey is distinct from row_id
  union all select 'pk', row_id::varchar, 'c_custkey', 'null key' from c where c_custkey is null),
keys as (select 'one name' as rule, '{{"c_name":"'||c_name||'"}}' object_id, 'c_name' field, count(*) times from c group by c_name having count(*) > 1
  union all select 'few', '{{"c_mktsegment":"'||c_mktsegment||'"}}', 'c_mktsegment', count(*) from c where row_id < 20 group by c_mktsegment having count(*) > 1)"""


@registry.add(
    "c1_d9_in_one_pass",
    f"{_ONE_PASS_SQL} select rule, object_id, field, detail, 1::bigint as times from found union all select rule, object_id, field, 'repeated key', times from keys",
)
def one_pass(spark, sf):
    """Ten rules on one table: one scan, one grouping."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    row_id = F.col("row_id")
    rules = [
        RowRule("required", "c_custkey", F.col("c_custkey").isNull(), "missing"), RowRule("named", "c_name", F.col("c_name") == "", "empty"),
        RowRule("segment", "c_mktsegment", ~F.col("c_mktsegment").isin(segments), F.col("c_mktsegment")), RowRule("least", "row_id", row_id < 10, row_id), RowRule("odd", "row_id", row_id % 11 == 0),
        RowRule("bounds", "row_id", ~row_id.between(3, 100), "out of bounds"), RowRule("own key", "c_custkey", ~F.col("c_custkey").eqNullSafe(row_id)),
        KeyRule("pk", ("c_custkey",), primary=True), KeyRule("one name", ("c_name",)), KeyRule("few", ("c_mktsegment",), "row_id < 20"),
    ]
    return check_all(broken(spark, sf)["customer"], row_id, rules)


@registry.add(
    "d7_check_bounds",
    """select o_orderkey, case when o_orderkey not between 5 and 100000 then 'out of bounds' else 'off grid' end as rule from orders
    where o_orderkey not between 5 and 100000 or (o_orderkey - 5) % 2 <> 0""",
)
def d7(spark, sf):
    return D.check_bounds(table(spark, sf, "orders"), "o_orderkey", 5, 2, 5, 100000).select("o_orderkey", "rule")


@registry.add(
    "d7_sequence_gaps",
    """with v as (select distinct o_orderkey v from orders where o_orderstatus <> 'O'), n as (select v, lead(v) over (order by v) nv from v)
    select v+1 as gap_start, nv-1 as gap_end, nv-v-1 as missing from n where nv - v > 1""",
)
def d7_gaps(spark, sf):
    return D.sequence_gaps(table(spark, sf, "orders").filter("o_orderstatus <> 'O'"), "o_orderkey")


@registry.add(
    "d7_gaps_by_step",
    """with v as (select distinct o_orderkey v from orders where o_orderkey%2=1 and o_orderkey%7<>0), n as (select v, lead(v) over (order by v) nv from v)
    select v+2 as gap_start, nv-2 as gap_end, (nv-v)//2-1 as missing from n where nv - v > 2""",
)
def d7_steps(spark, sf):
    """A sequence of odd numbers, without being told where it starts."""
    return D.sequence_gaps(table(spark, sf, "orders").filter("o_orderkey % 2 = 1 and o_orderkey % 7 <> 0"), "o_orderkey", 2)


@registry.add(
    "d7_gaps_by_sequence",
    """with rule as (select c_custkey, 1 + c_custkey % 3 step, c_custkey % 5 start, 50000 most from customer),
    v as (select distinct o_custkey, o_orderkey v, step from orders join rule on o_custkey=c_custkey where o_orderkey between 0 and most and (o_orderkey - start) % step = 0),
    n as (select *, lead(v) over (partition by o_custkey order by v) nv from v)
    select o_custkey, v+step as gap_start, nv-step as gap_end, (nv-v)//step-1 as missing from n where nv - v > step""",
)
def d7_sequences(spark, sf):
    """A sequence per customer, each with a start, step and bounds of its own."""
    key = F.col("c_custkey")
    sequences = table(spark, sf, "customer").select(key.alias("o_custkey"), (key % 5).alias("start"), (key % 3 + 1).alias("increment"), F.lit(0).alias("min_value"), F.lit(50000).alias("max_value"))
    return D.gaps_by_sequence(table(spark, sf, "orders"), "o_custkey", "o_orderkey", sequences)


@registry.add("d8_check_partial_unique", "select o_custkey, o_orderpriority, count(*) as times from orders where o_orderstatus = 'O' and o_custkey is not null and o_orderpriority is not null group by 1, 2 having count(*) > 1")
def d8(spark, sf):
    return D.check_partial_unique(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus = 'O'")


@registry.add("d9_check_generated", "select doc_id, n_chars + 1 as n_chars, length(text) as expected from documents where doc_id%40=0")
def d9(spark, sf):
    documents = table(spark, sf, "documents").withColumn("n_chars", F.expr("case when doc_id % 40 = 0 then n_chars + 1 else n_chars end"))
    return D.check_generated(documents, "n_chars", "cast(length(text) as bigint)").select("doc_id", "n_chars", "expected")


@registry.add("d9_check_generated_clean", "select doc_id from documents where n_chars <> length(text)")
def d9_clean(spark, sf):
    return D.check_generated(table(spark, sf, "documents"), "n_chars", "cast(length(text) as bigint)").select("doc_id")
