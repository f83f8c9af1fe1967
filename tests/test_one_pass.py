"""Many rules in one pass against the single checks."""

from pyspark.sql import Observation, functions as F

from palimpsest.operators import constraints as D, rules as C
from palimpsest.operators.one_pass import KeyRule, RowRule, check_all


def test_same_violations_as_single_checks(spark, tmp_path):
    rows = [(i, i % 7 if i % 5 else None, "" if i % 6 == 0 else f"n{i % 9}", i % 4) for i in range(60)] + [(3, 3, "n3", 3)]
    spark.createDataFrame(rows, "i int, k int, n string, g int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [
        RowRule("required", "k", F.col("k").isNull(), "missing"), RowRule("min_length", "n", F.col("n") == "", "empty"), RowRule("minimum", "i", F.col("i") < 5, F.col("i")),
        RowRule("domain", "g", ~F.col("g").isin(0, 1, 2), F.col("g")), RowRule("expr", "i", ~F.expr("i % 8 <> 1")), RowRule("null passes", "k", F.col("k") > 4),
        KeyRule("pk", ("k", "g"), primary=True), KeyRule("unique", ("n", "g")), KeyRule("partial", ("n",), "g = 1"), KeyRule("no clash", ("i", "n"), "i > 3"),
    ]
    counts = Observation()
    found = check_all(df, F.col("i"), rules, counts)
    got = {}
    for r in found.collect():
        got.setdefault(r.rule, []).append(r)
    ids = lambda name: sorted(int(r.object_id) for r in got[name] for _ in range(r.times))
    assert ids("required") == sorted(int(r.object_id) for r in C.required(df, F.col("i"), ["k"]).collect())
    assert ids("min_length") == sorted(int(r.object_id) for r in C.min_length(df, F.col("i"), ["n"]).collect())
    assert ids("minimum") == sorted(int(r.object_id) for r in C.minimum(df, F.col("i"), "i", 5).collect())
    assert ids("expr") == sorted(r.i for r in D.check_expr(df, "i % 8 <> 1").collect())
    assert ids("null passes") == sorted(i for i, k, _, _ in rows if k is not None and k > 4)
    pk = D.check_pk(df, ["k", "g"]).collect()
    assert sorted(r.times for r in got["pk"] if r.detail == "repeated key") == sorted(r.times for r in pk if r.rule == "repeated key")
    assert sum(r.times for r in got["pk"] if r.detail == "null key") == sum(r.times for r in pk if r.rule == "null key")
    assert sorted(r.times for r in got["unique"]) == sorted(r.times for r in D.check_unique(df, ["n", "g"]).collect())
    assert sorted(r.times for r in got["partial"]) == sorted(r.times for r in D.check_partial_unique(df, ["n"], "g = 1").collect())
    assert "no clash" not in got and counts.get["rows"] == 61 and counts.get["r0"] == 12
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("FileScan parquet") == 1


def test_empty_tables_and_no_rules(spark):
    df = spark.createDataFrame([], "k int, n string")
    assert check_all(df, F.col("k"), [KeyRule("u", ("n",)), RowRule("r", "k", F.col("k") > 1)]).isEmpty()
    odd = spark.createDataFrame([(1, "x.y"), (1, "x.y")], "rule int, `a.b` string")
    assert [(r.rule, r.times) for r in check_all(odd, F.col("rule"), [KeyRule("u", ("a.b",))]).collect()] == [("u", 2)]
