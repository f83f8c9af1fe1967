"""Joins and groups that grow with the data are dealt out by key: nothing large is sent through the driver or held by one task."""

import re
from datetime import datetime

from palimpsest.operators import governance as G, rules as C, sections, versions as V
from palimpsest.operators.aggregates import distinct_sorted, nest, with_lists
from palimpsest.operators.groups import lists_in_group, rank_in_group
from palimpsest.operators.relational import resolve_by_priority
from palimpsest.plans.corpus import _statements
from palimpsest.sources.commits import read_commits, with_commit_ids, write_commits
from pyspark.sql import functions as F, types as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_columns_are_merged_not_sent(spark):
    live = spark.createDataFrame([("n", "t", "a"), ("n", "t", "a"), ("n", "t", "b"), (None, "t", "a")], "ns string, tab string, col string")
    members = spark.createDataFrame([("n", "t", "i1", ["a", "c"]), ("n", "u", "i2", ["a"]), (None, "t", "i3", ["a"])], "ns string, tab string, id string, cols array<string>")
    found = C.known_columns(members, ["ns", "tab"], F.col("id"), "cols", live, "col")
    assert sorted((r.object_id, r.detail) for r in found.collect()) == [("i1", "c"), ("i2", "a"), ("i3", "a")]
    assert "Broadcast" not in plan(found)
    parents = C.known_parent(members, ["ns", "tab"], F.col("id"), live.select("ns", "tab").distinct())
    assert sorted(r.object_id for r in parents.collect()) == ["i2", "i3"]
    assert "Broadcast" not in plan(parents)


def test_gates_are_merged_and_differences_stay_spread(spark):
    left = spark.createDataFrame([(i, i % 3, "x" * 40) for i in range(60)], "k bigint, v int, t string")
    right = left.where("k <> 7").withColumn("v", F.expr("if(k % 10 = 0, -1, v)"))
    changes = V.change_set(left, right, ["k"])
    assert sorted((r.k, r.kind) for r in changes.collect()) == [(0, "changed"), (7, "removed"), *((i, "changed") for i in range(10, 60, 10))]
    assert changes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    risky = G.classify_risk(changes).withColumn("scope", F.col("k") % 2)
    passed = G.gate(risky, ["scope"])
    assert sorted(r.k for r in passed.collect()) == [0, 10, 20, 30, 40, 50] and "Broadcast" not in plan(passed)
    odd = G.gate(risky.withColumn("scope", F.when(F.col("k") > 30, F.lit(1)).when(F.col("kind") == "removed", F.lit(1))), ["scope"])
    assert sorted(r.k for r in odd.collect()) == [0, 10, 20, 30]
    patched = V.apply_diff(left, changes, ["k"])
    assert patched.exceptAll(right).isEmpty() and patched.count() == right.count() and "BroadcastHashJoin" not in plan(patched)


def test_lists_and_ranks_stay_spread(spark):
    rows = spark.createDataFrame([(i % 20 or None, i // 2, f"v{i % 4}") for i in range(80)], "k bigint, o bigint, v string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = lists_in_group(rows, ["k"], F.col("v"), ["o"], "vs")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.o, r.v)):
        want.setdefault(r.k, []).append(r.v)
    assert {r.k: r.vs for r in lists.collect()} == want and lists.rdd.getNumPartitions() == tasks
    assert "partial_collect_list" not in plan(lists).split("Exchange")[-1]
    assert rank_in_group(rows, ["k"], ["o"]).rdd.getNumPartitions() == tasks


def test_nested_parents_are_merged(spark):
    parents = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k bigint")
    a = spark.createDataFrame([(1, "x"), (1, "w"), (2, "y"), (9, "z")], "k bigint, id string")
    b = spark.createDataFrame([(2, "p"), (2, "p")], "k bigint, id string")
    for limit, one in ((None, ["w", "x"]), (5, ["w", "x"])):
        found = nest(parents, ["k"], limit, a=(a, F.col("id"), ["id"]), b=(b, F.col("id"), ["id"]))
        assert found.columns == ["k", "part", "a", "b"]
        assert sorted((r.k, r.part, r.a, r.b) for r in found.collect()) == [(1, 0, one, []), (1, 0, one, []), (2, 0, ["y"], ["p", "p"]), (3, 0, [], [])]
        assert "Broadcast" not in plan(found)
    parted = nest(parents, ["k"], 1, a=(a, F.col("id"), ["id"]), b=(b, F.col("id"), ["id"]))
    assert sorted((r.k, r.part, r.a, r.b) for r in parted.distinct().collect()) == [(1, 0, ["w"], []), (1, 1, ["x"], []), (2, 0, ["y"], ["p"]), (2, 1, [], ["p"]), (3, 0, [], [])]


def test_resolved_names_are_merged(spark):
    refs = spark.createDataFrame([("s", "v1", "a"), ("s", "v1", "b"), ("s", "v2", "none")], "s string, id string, name string")
    known = spark.createDataFrame([("s", "x:a"), ("s", "y:a"), ("s", "y:b"), ("o", "x:none")], "s string, key string")
    tried = F.array(F.concat(F.lit("x:"), "name"), F.concat(F.lit("y:"), "name"))
    found = resolve_by_priority(refs, ["id", "name"], tried, known, ["s"], "key")
    assert sorted((r.id, r.resolved) for r in found.collect()) == [("v1", "x:a"), ("v1", "y:b")] and "Broadcast" not in plan(found)
    lists = distinct_sorted(found, ["id"], "resolved", "to")
    whole = with_lists(refs.select("id").distinct(), lists, ["id"], "to")
    assert sorted((r.id, r.to) for r in whole.collect()) == [("v1", ["x:a", "y:b"]), ("v2", [])] and "BroadcastHashJoin" not in plan(whole)


def test_statements_are_dealt_out_before_they_are_unfolded(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert _statements(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_small_groups_go_in_batches(spark):
    rows = spark.createDataFrame([(i % 7 or None, f"s{i % 3}", i) for i in range(210)], "repo_id bigint, start string, number bigint")
    schema = T.StructType.fromDDL("repo_id bigint, start string, total bigint, n int")
    found = sections._per_group(rows, ["repo_id", "start"], lambda key, own: iter([(*key, sum(x for x, in own), len(own))]), schema)
    want = rows.groupBy("repo_id", "start").agg(F.sum("number").alias("total"), F.count("*").cast("int").alias("n"))
    assert found.count() == 21 and found.exceptAll(want).isEmpty()
    assert sections._per_group(rows.limit(0), ["repo_id", "start"], lambda key, own: iter([(*key, 0, 0)]), schema).isEmpty()


def test_commits_asked_for_come_from_their_folders(spark, tmp_path):
    rows = [([], "a" * 64, f"m{i}", "me", datetime(2024, 1, 1, 0, 0, i % 60), "text", "") for i in range(64)]
    given = spark.createDataFrame(rows, "parents array<string>, schema_hash string, migration_id string, author string, ts timestamp_ntz, message string, risk_level string")
    commits = with_commit_ids(given)[0]
    for _ in range(2):
        write_commits(commits.coalesce(1), f"{tmp_path}/commits")
    asked = sorted(r.sha for r in commits.collect())[:3]
    found = read_commits(spark, f"{tmp_path}/commits", spark.createDataFrame([(s,) for s in [*asked, "0" * 64, None]], "sha string"))
    assert sorted(r.sha for r in found.collect()) == asked
    assert re.search(r"PartitionFilters: \[[^\]]*prefix", plan(found))
    none = read_commits(spark, f"{tmp_path}/commits", spark.createDataFrame([], "sha string"))
    assert none.isEmpty()
