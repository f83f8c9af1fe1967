"""Comparing, merging and governing versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import governance as G, versions as V
from palimpsest.plans.inputs import BROKEN_SQL, CATALOG_SQL, VERSIONS_SQL, Registry, broken, catalog, listed, scratch, table, versions
from palimpsest.session import large
from palimpsest.sources import version_store

registry = Registry()

_WITH = f"with {VERSIONS_SQL}"
_DIFFERS = "(o.s is distinct from {0}.s or o.p is distinct from {0}.p or o.r is distinct from {0}.r)"
_KIND = "case when b.k is null then 'added' when o.k is null then 'removed' when " + _DIFFERS.format("b") + " then 'changed' else 'same' end"
_FIELDS = "concat_ws(',', case when o.p is distinct from b.p then 'p' end, case when o.r is distinct from b.r then 'r' end, case when o.s is distinct from b.s then 's' end)"

# The truth table, written out with presence flags.
MERGE_SQL = f"""{VERSIONS_SQL},
m as (select k, b.k is not null hb, o.k is not null ho, t.k is not null ht,
  b.s bs, b.p bp, b.r br, o.s os, o.p op, o.r "or", t.s ts, t.p tp, t.r tr
  from base b full join ours o using (k) full join theirs t using (k)),
f as (select *,
  (not ho and not ht) or (ho and ht and os is not distinct from ts and op is not distinct from tp and "or" is not distinct from tr) ot,
  (not hb and not ho) or (hb and ho and bs is not distinct from os and bp is not distinct from op and br is not distinct from "or") bo,
  (not hb and not ht) or (hb and ht and bs is not distinct from ts and bp is not distinct from tp and br is not distinct from tr) bt,
  coalesce(os is distinct from ts and os is distinct from bs and ts is distinct from bs, false) xs,
  coalesce(op is distinct from tp and op is distinct from bp and tp is distinct from bp, false) xp,
  coalesce("or" is distinct from tr and "or" is distinct from br and tr is distinct from br, false) xr from m),
j as (select *, case when ot or bo or bt then null when hb and ho and ht then case when xs or xp or xr then 'field' end when not hb then 'add_add' else 'modify_delete' end kind from f),
g as (select *, case when kind is not null then 'conflict' when (ot and not ho) or (not ot and bt and not ho) or (not ot and not bt and bo and not ht) then 'deleted' else 'clean' end status,
  case kind when 'field' then concat_ws(',', case when xp then 'p' end, case when xr then 'r' end, case when xs then 's' end)
    when 'add_add' then concat_ws(',', case when op is distinct from tp then 'p' end, case when "or" is distinct from tr then 'r' end, case when os is distinct from ts then 's' end) else '' end fields,
  case when ot or bt then os when bo then ts when os is not distinct from bs then ts else os end ms,
  case when ot or bt then op when bo then tp when op is not distinct from bp then tp else op end mp,
  case when ot or bt then "or" when bo then tr when "or" is not distinct from br then tr else "or" end mr from j)"""


def _merged(spark, sf):
    return V.merge3(*versions(spark, sf), ["k"])


@registry.add("v1_diff", f"{_WITH} select k, {_KIND} as kind from base b full join ours o using (k)")
def v1(spark, sf):
    base, ours, _ = versions(spark, sf)
    return V.diff(base, ours, ["k"])


@registry.add("v2_changed_fields", f"{_WITH} select k, {_FIELDS} as fields from base b join ours o using (k) where {_DIFFERS.format('b')}")
def v2(spark, sf):
    base, ours, _ = versions(spark, sf)
    return V.changed_fields(base, ours, ["k"]).select("k", listed("fields"))


@registry.add(
    "v12_change_set",
    f"{_WITH} select k, {_KIND} as kind, case when b.k is null or o.k is null then '' else {_FIELDS} end as fields, o.s, o.p, o.r from base b full join ours o using (k) where {_KIND} <> 'same'",
)
def v12(spark, sf):
    base, ours, _ = versions(spark, sf)
    return V.change_set(base, ours, ["k"]).select("k", "kind", listed("fields"), "s", "p", "r")


@registry.add(
    "v3_merge3",
    f"with {MERGE_SQL} select k, status, kind, fields, case when status='clean' then ms end as s, case when status='clean' then mp end as p, case when status='clean' then mr end as r from g",
)
def v3(spark, sf):
    return _merged(spark, sf).select("k", "status", "kind", listed("fields"), "merged.s", "merged.p", "merged.r")


def _json(prefix: str, flag: str, s: str, p: str, r: str) -> str:
    return f"""case when {flag} then '{{"s":"'||{s}||'","p":'||{p}::varchar||',"r":"'||{r}||'"}}' end as {prefix}"""


@registry.add(
    "v4_conflicts",
    f"""with {MERGE_SQL} select 'row:orders.'||k::varchar as object_id, kind, {_json("base", "hb", "bs", "bp", "br")}, {_json("ours", "ho", "os", "op", '"or"')}, {_json("theirs", "ht", "ts", "tp", "tr")},
      fields, kind||' conflict'||case when fields='' then '' else ' in '||replace(fields, ',', ', ') end as message from g where status='conflict'""",
)
def v4(spark, sf):
    found = V.conflicts(_merged(spark, sf), ["k"], "orders")
    return found.select("object_id", "kind", "base", "ours", "theirs", listed("fields"), "message")


@registry.add("v5_resolve_none", f"with {MERGE_SQL} select k, ms as s, mp as p, mr as r from g where status='clean'")
def v5_none(spark, sf):
    return V.resolve(_merged(spark, sf), ["k"])


def _resolved_sql(side: str, flag: str, s: str, p: str, r: str) -> str:
    pick = lambda x, own, mine: f"case when kind='field' then case when {x} then {mine} else {own} end when kind is not null then {mine} else {own} end"
    return f"""with {MERGE_SQL} select k, {pick("xs", "ms", s)} as s, {pick("xp", "mp", p)} as p, {pick("xr", "mr", r)} as r from g where status='clean' or kind='field' or (kind is not null and {flag})"""


@registry.add("v5_resolve_ours", _resolved_sql("ours", "ho", "os", "op", '"or"'))
def v5_ours(spark, sf):
    return V.resolve(_merged(spark, sf), ["k"], "ours")


@registry.add("v5_resolve_theirs", _resolved_sql("theirs", "ht", "ts", "tp", "tr"))
def v5_theirs(spark, sf):
    return V.resolve(_merged(spark, sf), ["k"], "theirs")


@registry.add("v6_apply_diff", f"{_WITH} select k, s, p, r from ours")
def v6(spark, sf):
    base, ours, _ = versions(spark, sf)
    return V.apply_diff(base, V.change_set(base, ours, ["k"]), ["k"])


@registry.add(
    "v7_classify_risk",
    f"""{_WITH} select k, {_KIND} as kind, case when o.k is null or (b.k is not null and o.p < b.p) or (b.k is not null and length(o.s) < length(b.s)) then 'destructive' else 'safe' end as risk
    from base b full join ours o using (k) where {_KIND} <> 'same'""",
)
def v7(spark, sf):
    base, ours, _ = versions(spark, sf)
    before = base.select("k", F.col("s").alias("old_s"), F.col("p").alias("old_p"))
    changes = V.change_set(base, ours, ["k"]).join(large(before, ["k"]), "k", "left")
    narrowing = (F.col("kind") == "changed") & ((F.col("p") < F.col("old_p")) | (F.length("s") < F.length("old_s")))
    return G.classify_risk(changes, narrowing).select("k", "kind", "risk")


# Type changes and whether they lose room.
_TYPE_CHANGES = (
    ("numeric(10,2)", "numeric(10,4)", True), ("numeric(10,4)", "numeric(10,2)", True), ("varchar(255)[]", "varchar(10)[]", True), ("varchar(10)", "text", False),
    ("int4", "numeric", False), ("int4", "numeric(5)", True), ("int8", "int4", True), ("varchar(5)", "varchar", False), ("text", "varchar(9)", True), ("int4", "int4[]", True),
)


@registry.add(
    "v7_type_changes",
    f"""select c_custkey, before, after, case when lost then 'destructive' else 'safe' end as risk from customer join
    (values {", ".join(f"({i}, '{a}', '{b}', {str(x).lower()})" for i, (a, b, x) in enumerate(_TYPE_CHANGES))}) v(i, before, after, lost) on c_custkey % {len(_TYPE_CHANGES)} = i""",
)
def v7_types(spark, sf):
    """A type change per customer."""
    pairs = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b, _ in _TYPE_CHANGES])
    changes = table(spark, sf, "customer").select("c_custkey", F.lit("changed").alias("kind"), F.get(pairs, (F.col("c_custkey") % len(_TYPE_CHANGES)).cast("int")).alias("x"))
    risky = G.classify_risk(changes, G.narrows(F.col("x.before"), F.col("x.after")))
    return risky.select("c_custkey", "x.before", "x.after", "risk")


def _stored(spark, sf):
    """The three versions of orders, stored by key range."""
    folders = [scratch(spark, name) for name in ("base", "ours", "theirs")]
    for df, folder in zip(versions(spark, sf), folders):
        version_store.write_version(df, ["k"], folder, like=None if folder == folders[0] else folders[0], ranges=64)
    return folders


@registry.add("v1_diff_by_ranges", f"{_WITH} select k, {_KIND} as kind from base b full join ours o using (k) where {_KIND} <> 'same'")
def v1_ranges(spark, sf):
    base, ours, _ = _stored(spark, sf)
    return version_store.diff(spark, base, ours, ["k"])


@registry.add("v5_resolve_by_ranges", _resolved_sql("ours", "ho", "os", "op", '"or"'))
def v5_ranges(spark, sf):
    merged, rest = version_store.merge3(spark, *_stored(spark, sf), ["k"])
    return V.resolve(merged, ["k"], "ours").unionByName(rest)


CATALOG_DIFF_SQL = f"""{CATALOG_SQL},
left_cat as (select 'col:ns'||ns_oid::varchar||'.users.'||attname id, ns_oid, attname, attnum, not_null,
  case type_name when 'bigint' then 'int8' when 'character varying(255)' then 'varchar(255)' when 'public.user_role' then 'user_role' else type_name end type_name, coalesce(expression, '') d from columns),
right_cat as (select id, attname, attnum, not_null <> (ns_oid%5=0 and attname='score') not_null,
  case when ns_oid%4=0 and attname='id' then 'int4' when ns_oid%9=0 and attname='email' then 'varchar(300)' else type_name end type_name, case when ns_oid%7=0 and attname='score' then 'a - b' else d end d
  from left_cat where not (ns_oid%6=0 and attname='role')),
delta as (select coalesce(l.id, r.id) id, case when r.id is null then 'removed' else 'changed' end kind, l.type_name before, r.type_name after,
  case when r.id is null then '' else concat_ws(',', case when l.d <> r.d then 'd' end, case when l.not_null <> r.not_null then 'not_null' end, case when l.type_name <> r.type_name then 'type_name' end) end fields
  from left_cat l full join right_cat r on l.id=r.id
  where r.id is null or l.type_name <> r.type_name or l.d <> r.d or l.not_null <> r.not_null)"""


def _catalogs(spark, sf):
    """All columns of every namespace with all their fields, before and after some changes; an empty default counts as none."""
    columns = catalog(spark, sf)["columns"]
    kind = F.expr("case type_name when 'bigint' then 'int8' when 'character varying(255)' then 'varchar(255)' when 'public.user_role' then 'user_role' else type_name end")
    ident = F.concat(F.lit("col:ns"), F.col("ns_oid").cast("string"), F.lit(".users."), F.col("attname")).alias("id")
    left = columns.select(ident, "attname", "attnum", "not_null", kind.alias("type_name"), F.col("expression").alias("d"))
    changed = F.when(F.expr("ns_oid % 4 = 0 and attname = 'id'"), "int4").when(F.expr("ns_oid % 9 = 0 and attname = 'email'"), "varchar(300)").otherwise(kind)
    default = F.expr("case when ns_oid % 7 = 0 and attname = 'score' then 'a - b' else coalesce(expression, '') end")
    right = columns.filter("not (ns_oid % 6 = 0 and attname = 'role')").select(
        ident, "attname", "attnum", F.expr("not_null <> (ns_oid % 5 = 0 and attname = 'score')").alias("not_null"), changed.alias("type_name"), default.alias("d")
    )
    return left, right


@registry.add("v8_schema_diff", f"with {CATALOG_DIFF_SQL} select id, kind, after as type_name, fields from delta")
def v8(spark, sf):
    left, right = _catalogs(spark, sf)
    return G.schema_diff(left, right, "id", ["d"]).select("id", "kind", "type_name", listed("fields"))


_RISK_SQL = f"{CATALOG_DIFF_SQL}, risky as (select *, split_part(split_part(id, '.', 1), ':', 2) ns, case when kind='removed' or after='int4' then 'destructive' else 'safe' end risk from delta)"


def _risky(spark, sf):
    left, right = _catalogs(spark, sf)
    changes = G.schema_diff(left, right, "id", ["d"]).join(large(left.select("id", F.col("type_name").alias("before")), ["id"]), "id", "left")
    risky = G.classify_risk(changes, (F.col("kind") == "changed") & G.narrows(F.col("before"), F.col("type_name")))
    return risky.withColumn("ns", F.split_part(F.split_part("id", F.lit("."), F.lit(1)), F.lit(":"), F.lit(2)))


@registry.add("v7_catalog_risk", f"with {_RISK_SQL} select id, kind, risk from risky")
def v7_catalog(spark, sf):
    return _risky(spark, sf).select("id", "kind", "risk")


@registry.add("v7_gate_scoped", f"with {_RISK_SQL} select id, kind from risky where ns not in (select ns from risky where risk='destructive')")
def v7_gate(spark, sf):
    return G.gate(_risky(spark, sf), ["ns"]).select("id", "kind")


@registry.add("v7_gate_blocked", f"with {_RISK_SQL} select id, kind from risky where (select count(*) from risky where risk='destructive') = 0")
def v7_blocked(spark, sf):
    return G.gate(_risky(spark, sf)).select("id", "kind")


@registry.add("v7_gate_allowed", f"with {_RISK_SQL} select id, kind from risky")
def v7_allowed(spark, sf):
    return G.gate(_risky(spark, sf), block=False).select("id", "kind")


@registry.add(
    "v9_pending",
    f"""with {BROKEN_SQL} select migration_id, 'pending' as state from stored_migrations where migration_id not in (from ledger)
    union all select migration_id, 'unknown' from ledger where migration_id not in (select migration_id from stored_migrations)""",
)
def v9(spark, sf):
    b = broken(spark, sf)
    return G.pending(b["migrations"], b["ledger"])


@registry.add("v10_tampered", f"with {BROKEN_SQL} select sha256(doc_id::varchar) as migration_id, stored as checksum, sha256(text) as actual from tampered where stored <> sha256(text)")
def v10(spark, sf):
    stored = broken(spark, sf)["tampered"].select(F.sha2(F.col("doc_id").cast("string"), 256).alias("migration_id"), F.col("stored").alias("checksum"), F.col("text").alias("up_sql"))
    return G.tampered(stored)
