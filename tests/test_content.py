"""Encodings, fingerprints, the object store, migrations, conflicts and strict JSON."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.encoding import content_id, empty_as_absent, packed, row_text, unpacked
from palimpsest.operators.fingerprints import group_hash, table_hash
from palimpsest.operators.versions import conflicts, merge3
from palimpsest.plans.content import _commit_rows
from palimpsest.plans.inputs import history
from palimpsest.sources.commits import read_commits, verify_commits, with_commit_ids, write_commits
from palimpsest.sources.conflicts import clear_conflicts, read_conflicts, write_conflicts
from palimpsest.sources.migrations import NoMigrationLedger, applied_ids, list_migrations, read_ledger, read_migrations, with_checksums, write_migrations
from palimpsest.sources.objects import append_index, append_new, create_index, put_if_absent, put_into, read_objects, verify_objects
from palimpsest.sources.strict_json import strict_json


def test_encoding_is_unambiguous(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("ab", "c"), (None, "abc"), ("abc", None), ("", "abc"), ("N", ""), ("N;", ""), ("1:a", ""), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_text(df)).distinct().count() == len(rows)


def test_encoding_of_nested_and_odd_values(spark):
    df = spark.sql(
        """select * from values
        (array('a', null), map('k', 1), -0.0d, named_struct('p', cast(null as int)), X'00ff'),
        (array('a'), map('k', 1), 0.0d, named_struct('p', 1), X'00ff') t(a, m, d, s, b)"""
    )
    texts = [r[0] for r in df.select(row_text(df)).collect()]
    assert len(set(texts)) == 2 and None not in texts
    assert df.select(row_text(df, ["d"])).distinct().count() == 1


def test_table_hash_ignores_order_and_partitions(spark):
    df = spark.range(500).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    one = table_hash(df.repartition(1)).first()
    assert one == table_hash(df.orderBy(F.desc("id")).repartition(9)).first()
    assert one.row_count == 500
    assert one != table_hash(df.unionByName(df.limit(1))).first()
    assert one != table_hash(df.withColumnRenamed("v", "w")).first()
    twice = df.unionByName(df)
    assert table_hash(twice).first() != one
    assert table_hash(df.filter("id < 0")).first().row_count == 0


def test_group_hash_finds_equal_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("c", 1)], "g string, v int")
    hashes = {r.g: r.group_hash for r in group_hash(df, ["g"], ["v"]).collect()}
    assert hashes["a"] == hashes["b"] != hashes["c"]


def test_empty_optional_fields_hash_alike(spark):
    df = spark.createDataFrame([("a", "", False, []), ("a", None, None, None)], "id string, d string, f boolean, l array<string>")
    filled = empty_as_absent(df, ["d", "f", "l"])
    assert filled.select(content_id(filled)).distinct().count() == 1
    assert empty_as_absent(df, [], ["l"]).filter("l is null").count() == 0


def test_object_store(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = spark.createDataFrame([], "sha string, content string")
    offered = spark.createDataFrame([("a",), ("b",), ("b",)], "content string")
    first = put_if_absent(offered, empty)
    assert sorted(r.outcome for r in first.collect()) == ["new", "new"]
    append_new(first, path)
    stored = read_objects(spark, path)
    assert {r.outcome for r in put_if_absent(offered, stored).collect()} == {"existing"}
    assert verify_objects(stored).isEmpty()
    sha = stored.filter("content = 'a'").first().sha
    assert [r.content for r in read_objects(spark, path, sha).collect()] == ["a"]
    bad = stored.withColumn("content", F.expr("case when content = 'a' then 'x' else content end"))
    assert {r.content: r.outcome for r in put_if_absent(offered, bad).collect()} == {"a": "collision", "b": "existing"}
    assert [r.sha for r in verify_objects(bad).collect()] == [sha]


def test_commit_ids(spark):
    h = "a" * 64
    rows = [
        ([], h, "", "tester", "2026-07-02 09:00:00", "first", "low"),
        (None, h, None, "tester", "2026-07-02 09:00:00", "first", "low"),
        ([h, "b" * 64], h, None, "tester", "2026-07-02 09:00:00", "merge", "low"),
        (["b" * 64, h], h, None, "tester", "2026-07-02 09:00:00", "merge", "low"),
        (["short"], h, None, "t", "2026-07-02 09:00:00", "bad parent", None),
        ([], "short", None, "t", "2026-07-02 09:00:00", "bad schema", None),
    ]
    df = spark.createDataFrame(rows, "parents array<string>, schema_hash string, migration_id string, author string, at string, message string, risk_level string")
    df = df.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    written, refused = with_commit_ids(df)
    ids = [r.sha for r in written.collect()]
    assert len(ids) == 4 and len(set(ids)) == 3
    assert sorted(r.reason for r in refused.collect()) == ["invalid parent hash", "invalid schema hash"]
    east = with_commit_ids(df.withColumn("ts", F.col("ts") + F.expr("interval 9 hours")), "Asia/Tokyo")[0]
    assert sorted(r.sha for r in east.collect()) == sorted(ids)
    assert verify_commits(written).isEmpty()
    assert verify_commits(written.withColumn("message", F.lit("other"))).count() == 4


def test_migrations_and_ledger(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("b" * 64, "up b", "down"), ("a" * 64, "up a", "down"), ("short", "x", "y")], "migration_id string, up_sql string, down_sql string")
    assert [r.migration_id for r in with_checksums(df)[1].collect()] == ["short"]
    write_migrations(df, path)
    assert [r.migration_id for r in list_migrations(read_migrations(spark, path)).collect()] == ["a" * 64, "b" * 64]
    with pytest.raises(NoMigrationLedger):
        read_ledger(spark, str(tmp_path / "none"))
    ledger = str(tmp_path / "ledger")
    spark.createDataFrame([], "migration_id string, applied_at timestamp").write.parquet(ledger)
    assert applied_ids(read_ledger(spark, ledger)).isEmpty()


def test_conflicts_are_replaced_per_merge(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *r: spark.createDataFrame(r, "k int, v int")
    both = conflicts(merge3(rows((1, 0), (2, 0)), rows((1, 1), (2, 1)), rows((1, 2)), ["k"]), ["k"], "t")
    one = both.filter("kind = 'field'")
    write_conflicts(both, "m1", path)
    write_conflicts(one, "m2", path)
    assert [r.object_id for r in read_conflicts(spark, path, "m1").collect()] == ["row:t.1", "row:t.2"]
    write_conflicts(one, "m1", path)
    assert [r.object_id for r in read_conflicts(spark, path, "m1").collect()] == ["row:t.1"]
    write_conflicts(both.filter("false"), "m1", path)
    assert read_conflicts(spark, path, "m1").isEmpty() and read_conflicts(spark, path, "m2").count() == 1
    clear_conflicts(spark, "m2", path)
    assert read_conflicts(spark, path).isEmpty()


def test_strict_json(spark):
    texts = ['{"version": 1}', '{"version": 1, "extra": true}', '{"version": 1} x', '{"version": 1}, {"version": 2}', "{", "", None, "[1]", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    got = {r.i: r.problem for r in strict_json(df, "j", ["version"]).collect()}
    assert got == {1: "unknown keys", 2: "malformed", 3: "malformed", 4: "malformed", 5: "malformed", 6: "malformed", 7: "malformed"}


def test_a_batch_meets_the_index_of_a_store(spark, tmp_path):
    store = spark.createDataFrame([(f"text {i}",) for i in range(40)], "content string")
    create_index(spark, "held_objects", str(tmp_path / "index"), 4)
    try:
        first = put_into(store, "held_objects")
        assert {r.outcome for r in first.collect()} == {"new"}
        append_index(first, "held_objects", 4)
        forged = spark.createDataFrame([("text 1", "other bytes")], "name string, content string")
        index = forged.select(F.sha2("name", 256).alias("sha"), "content", F.lit("new").alias("outcome"))
        batch = spark.createDataFrame([("text 1",), ("text 2",), ("text 2",), ("fresh",), (None,)], "content string")
        found = put_into(batch, "held_objects")
        assert sorted((r.content, r.outcome) for r in found.where("content is not null").collect()) == [("fresh", "new"), ("text 1", "existing"), ("text 2", "existing")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        held = plan[plan.index("Scan parquet") :]
        assert "Bucketed: true" in plan or "Scan parquet spark_catalog.default.held_objects" in plan
        assert "content" not in held.split("ReadSchema")[-1]
        append_index(index, "held_objects", 4)
        assert [r.outcome for r in put_into(batch.where("content = 'text 1'"), "held_objects").collect()] == ["collision"]
    finally:
        spark.sql("drop table if exists held_objects")


def test_index_side_is_not_shuffled(spark, tmp_path):
    create_index(spark, "held_index", str(tmp_path / "index"), 4)
    try:
        append_index(spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.col("id").cast("string").alias("content"), F.lit("new").alias("outcome")), "held_index", 4)
        batch = spark.range(300).select(F.col("id").cast("string").alias("content"))
        conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.enabled": "false"}
        old = {k: spark.conf.get(k) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = put_into(batch, "held_index")._jdf.queryExecution().executedPlan().toString()
        for k, v in old.items():
            spark.conf.set(k, v)
        scan = plan.index("held_index")
        before = plan[:scan].rindex("SortMergeJoin")
        assert "Exchange" not in plan[before:scan].split("Sort [sha")[-1]
    finally:
        spark.sql("drop table if exists held_index")


def test_commits_come_back_once(spark, tmp_path):
    rows = spark.createDataFrame([(["ab" * 32], "cd" * 32, "m1", "me", "2024-01-01 00:00:00", "first", ""), ([], "cd" * 32, None, "me", "2024-01-02 00:00:00", "second", "safe"), (["bad"], "cd" * 32, None, "me", "2024-01-02 00:00:00", "third", ""), ([], "none", None, "me", "2024-01-02 00:00:00", "fourth", "")], "parents array<string>, schema_hash string, migration_id string, author string, ts string, message string, risk_level string")
    written, refused = with_commit_ids(rows)
    assert sorted((r.message, r.reason) for r in refused.collect()) == [("fourth", "invalid schema hash"), ("third", "invalid parent hash")]
    for _ in range(2):
        write_commits(written, str(tmp_path / "c"))
    back = read_commits(spark, str(tmp_path / "c"))
    assert sorted(r.message for r in back.collect()) == ["first", "second"] and verify_commits(back).isEmpty()
    assert verify_commits(back.withColumn("author", F.lit("you"))).count() == 2
    one = back.where("message = 'first'").select("sha")
    assert [r.message for r in read_commits(spark, str(tmp_path / "c"), one).collect()] == ["first"]


def test_conflicts_of_a_merge_are_replaced_in_one_write(spark, tmp_path):
    path = str(tmp_path / "k")
    rows = spark.createDataFrame([("row:t.1", "field", "{}", "{}", "{}", ["a"], "m")], "object_id string, kind string, base string, ours string, theirs string, fields array<string>, message string")
    write_conflicts(rows, "m/1", path)
    write_conflicts(rows.withColumn("object_id", F.lit("row:t.2")), "m2", path)
    write_conflicts(rows.withColumn("object_id", F.lit("row:t.3")), "m/1", path)
    assert [r.object_id for r in read_conflicts(spark, path).collect()] == ["row:t.2", "row:t.3"]
    clear_conflicts(spark, "m2", path)
    assert [r.object_id for r in read_conflicts(spark, path).collect()] == ["row:t.3"]


def test_packed_texts_come_back(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 31 + "a", "ab" * 32 + "\n", "", "0", "00", "\x01ab", "é", "none", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", packed(F.col("t")))
    found = {r.i: (r.back, r.n) for r in rows.select("i", unpacked(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()}
    assert [found[i][0] for i in range(len(texts))] == texts and found[0][1] == 33 and found[1][1] == 65
    assert rows.select("p").distinct().count() == len(texts)


def test_stored_commits_travel_as_bytes(spark, tmp_path):
    """Hashes are bytes in the shuffles of a store, and texts again behind them; copies with equal names are one row."""
    rows = [("a" * 64, ["b" * 64, "not a hash", None], "c" * 64, "x"), ("d" * 64, [], "none", "y"), ("e" * 64, None, None, "z"), ("short", ["f" * 64], "A" * 64, "w")]
    commits = spark.createDataFrame(rows, "sha string, parents array<string>, schema_hash string, author string")
    for _ in range(2):
        write_commits(commits, str(tmp_path / "c"))
    back = read_commits(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.select("sha", "parents", "schema_hash", "author").collect())) == sorted(rows)
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "unhex" in plan[plan.index(grouped):] and back.schema["sha"].dataType.simpleString() == "string"


def test_commits_of_orders_and_their_parents(spark, tmp_path):
    """Parents by the keys of orders: the same lists as by names, for orders that come twice too."""
    days = [datetime(2024, 1, d) for d in range(1, 9)]
    rows = [(k, k % 2, "O", 1.0, day, "1-URGENT") for k, day in zip((1, 2, 3, 4, 5, 15, 25, 31), days)] + [(15, 1, "O", 1.0, days[7], "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    edges = history(spark, str(tmp_path))["edges"].collect()
    expected = {}
    for e in sorted(edges, key=lambda e: (e.child, e.idx, e.parent)):
        expected.setdefault(e.child, []).append(e.parent)
    found = _commit_rows(spark, str(tmp_path)).select("o_orderkey", "parents").collect()
    name = lambda k: hashlib.sha256(f"c|{k}".encode()).hexdigest()
    assert len(found) == 11 and len(edges) > 8 and all(r.parents == expected.get(name(r.o_orderkey)) for r in found)
