"""Laws of diff and merge, and rule checks on small inputs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palimpsest.operators import constraints as D, governance as G, versions as V
from palimpsest.sources import version_store


def make(spark, *rows):
    return spark.createDataFrame(rows, "k int, a string, b int")


def as_set(df):
    return sorted(map(tuple, df.select("k", "a", "b").collect()))


@pytest.fixture(scope="module")
def three(spark):
    base = make(spark, (1, "x", 1), (2, "x", None), (3, "x", 3), (4, "x", 4), (5, None, None))
    ours = make(spark, (1, "y", 1), (2, None, None), (4, "x", 5), (5, None, None), (6, "n", 6), (7, "n", 7))
    theirs = make(spark, (1, "x", 9), (2, "z", None), (3, "x", 8), (4, "x", 4), (6, "n", 6), (7, "m", 7))
    return base, ours, theirs


def test_diff_and_fields(three):
    base, ours, _ = three
    assert {r.k: r.kind for r in V.diff(base, ours, ["k"]).collect()} == {1: "changed", 2: "changed", 3: "removed", 4: "changed", 5: "same", 6: "added", 7: "added"}
    assert {r.k: r.fields for r in V.changed_fields(base, ours, ["k"]).collect()} == {1: ["a"], 2: ["a"], 4: ["b"]}


def test_patch_restores_target(three):
    for left in three:
        for right in three:
            assert as_set(V.apply_diff(left, V.change_set(left, right, ["k"]), ["k"])) == as_set(right)


def test_merge_laws(three):
    base, ours, theirs = three
    for x in (ours, theirs):
        assert as_set(V.resolve(V.merge3(base, x, base, ["k"]), ["k"])) == as_set(x)
        assert as_set(V.resolve(V.merge3(base, base, x, ["k"]), ["k"])) == as_set(x)
        assert as_set(V.resolve(V.merge3(base, x, x, ["k"]), ["k"])) == as_set(x)


def test_merge_truth_table(three):
    merged = V.merge3(*three, ["k"])
    got = {r.k: (r.status, r.kind, r.fields) for r in merged.collect()}
    assert got == {
        1: ("clean", None, []), 2: ("conflict", "field", ["a"]), 3: ("conflict", "modify_delete", []), 4: ("clean", None, []),
        5: ("deleted", None, []), 6: ("clean", None, []), 7: ("conflict", "add_add", ["a"]),
    }
    assert as_set(V.resolve(merged, ["k"])) == [(1, "y", 9), (4, "x", 5), (6, "n", 6)]
    assert as_set(V.resolve(merged, ["k"], "ours")) == sorted([(1, "y", 9), (2, None, None), (4, "x", 5), (6, "n", 6), (7, "n", 7)], key=lambda r: r[0])
    assert as_set(V.resolve(merged, ["k"], "theirs")) == [(1, "y", 9), (2, "z", None), (3, "x", 8), (4, "x", 5), (6, "n", 6), (7, "m", 7)]
    with pytest.raises(ValueError):
        V.resolve(merged, ["k"], "mine")


def test_repeated_keys_are_refused(spark):
    left = make(spark, (1, "x", 1), (1, "y", 1))
    with pytest.raises(PySparkException, match="repeated key in right: 1"):
        V.diff(make(spark, (1, "x", 1)), left, ["k"]).collect()


def test_gate(three):
    base, ours, _ = three
    risky = G.classify_risk(V.change_set(base, ours, ["k"]))
    assert G.gate(risky).isEmpty() and G.gate(risky, block=False).count() == 6
    assert G.gate(risky.filter("kind <> 'removed'")).count() == 5
    assert sorted(r.k for r in G.gate(risky, ["k"]).collect()) == [1, 2, 4, 6, 7]


def test_checks_pass_nulls(spark):
    df = make(spark, (1, None, None), (2, None, 5), (None, "x", 5), (2, "x", 4))
    assert [(r.k, r.rule) for r in D.check_pk(df, ["k"]).orderBy("k").collect()] == [(None, "null key"), (2, "repeated key")]
    assert D.check_unique(df, ["a", "b"]).isEmpty()
    with pytest.raises(ValueError):
        D.check_unique(df, ["a"], nulls_distinct=False)
    assert D.check_expr(df, "b > 4").count() == 1
    assert D.check_fk(df, ["a", "b"], make(spark, (0, "x", 5)), ["a", "b"]).select("k").collect() == [(2,)]
    assert D.check_enum(df, "a", ["y"]).count() == 2
    assert [(r.field, r.violations) for r in D.check_not_null(df, ["k", "a"]).collect()] == [("k", 1), ("a", 2)]
    assert {r.rule for r in D.check_bounds(df, "b", 4, 2, 4, 4).collect()} == {"out of bounds"}
    assert D.check_generated(df.withColumn("g", F.lit(5)), "g", "b").count() == 2


def stored(spark, tmp_path, *versions, ranges=16):
    folders = []
    for i, df in enumerate(versions):
        folders.append(str(tmp_path / f"v{i}"))
        version_store.write_version(df, ["k"], folders[i], like=folders[0] if i else None, ranges=ranges)
    return folders


def rows_read(df):
    """Rows the parquet scans of a plan gave, after it ran."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        node = node.finalPhysicalPlan() if node.nodeName().startswith("AdaptiveSparkPlan") else node.plan() if "QueryStage" in node.nodeName() else node
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_stored_versions_read_only_ranges_that_differ(spark, tmp_path):
    base = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("a"), "id").alias("a"), (F.col("id") % 7).cast("int").alias("b"))
    ours = base.withColumn("a", F.when(F.col("k").between(5000, 5040), "new").otherwise(F.col("a"))).filter("k <> 5100")
    theirs = base.withColumn("b", F.when(F.col("k") == 5001, 100).when(F.col("k") == 19_000, 5).otherwise(F.col("b"))).unionByName(make(spark, (30_000, "x", 1)))
    folders = stored(spark, tmp_path, base, ours, theirs, ranges=100)
    assert len(version_store.changed_ranges(spark, folders[0], folders[1])) <= 2
    found = version_store.diff(spark, *folders[:2], ["k"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, V.diff(base, ours, ["k"], keep_same=False).collect()))
    assert rows_read(found) <= 0.05 * 40_000
    assert as_set(version_store.change_set(spark, folders[1], folders[0], ["k"])) == as_set(V.change_set(ours, base, ["k"]))
    merged, rest = version_store.merge3(spark, *folders, ["k"])
    for strategy in (None, "ours"):
        assert as_set(V.resolve(merged, ["k"], strategy).unionByName(rest)) == as_set(V.resolve(V.merge3(base, ours, theirs, ["k"]), ["k"], strategy))
    same = stored(spark, tmp_path / "same", base, base.repartition(5), ranges=10)
    assert version_store.changed_ranges(spark, *same) == [] and version_store.diff(spark, *same, ["k"]).isEmpty()


def test_stored_versions_of_odd_tables(spark, tmp_path, three):
    base, ours, theirs = three
    folders = stored(spark, tmp_path, base.limit(0), ours, base.limit(0))
    assert sorted(r.kind for r in version_store.diff(spark, *folders[:2], ["k"]).collect()) == ["added"] * 6
    assert version_store.diff(spark, folders[0], folders[2], ["k"]).isEmpty()
    other = stored(spark, tmp_path / "o", theirs, base, ranges=4)
    assert as_set(version_store.change_set(spark, *other, ["k"])) == as_set(V.change_set(theirs, base, ["k"]))
    with pytest.raises(ValueError, match="borders"):
        version_store.diff(spark, folders[0], other[0], ["k"])
    null_key = make(spark, (None, "n", 1), (2, "x", 2))
    pair = stored(spark, tmp_path / "n", null_key, null_key.withColumn("b", F.lit(9)), ranges=3)
    assert version_store.diff(spark, *pair, ["k"]).count() == 2


def test_no_sort_before_the_shuffle(three):
    base, ours, theirs = three
    for df in (V.diff(base, ours, ["k"]), V.change_set(base, ours, ["k"]), V.merge3(base, ours, theirs, ["k"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "Sort" not in plan[plan.rindex("Exchange") :]


def test_diff_sees_nulls_by_place_and_inside(spark):
    left = spark.createDataFrame([(1, None, "a", [1, None]), (2, "a", None, [None]), (3, "a", "b", None)], "k int, x string, y string, z array<int>")
    right = spark.createDataFrame([(1, "a", None, [1, None]), (2, "a", None, []), (3, "a", "b", None)], "k int, x string, y string, z array<int>")
    assert {r.k: r.kind for r in V.diff(left, right, ["k"]).collect()} == {1: "changed", 2: "changed", 3: "same"}
