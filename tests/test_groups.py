"""Ranks, lists and names are the same on the plain and on the spread way."""

import random

from pyspark.sql import functions as F

from palimpsest.operators.aggregates import distinct_first_seen, distinct_sorted, nest, ordered_list
from palimpsest.operators.constraints import sequence_gaps
from palimpsest.operators import groups
from palimpsest.operators.groups import rank_in_group
from palimpsest.operators.ordinals import default_names, densify


def skewed(spark):
    """A hot group with copies, small groups and a null group."""
    rnd = random.Random(7)
    rows = [("hot", rnd.randrange(60), rnd.choice("abc")) for _ in range(400)]
    rows += [("hot", 7, "a")] * 150
    rows += [(f"g{i % 30}", rnd.randrange(9), rnd.choice("abc")) for i in range(200)]
    rows += [(None, i % 4, "z") for i in range(40)]
    return rows, spark.createDataFrame(rows, "g string, o int, v string").repartition(5)


def test_rank_spread_equals_plain(spark):
    rows, df = skewed(spark)
    expected = {}
    for g, o, v in sorted(rows, key=lambda r: (r[1], r[2])):
        expected.setdefault(g, []).append((o, v))
    for limit in (20, 10_000):
        got = {}
        for r in rank_in_group(df, ["g"], ["o", "v"], "n", limit).orderBy("n").collect():
            got.setdefault(r.g, []).append(((r.o, r.v), r.n))
        assert {g: [x for x, _ in xs] for g, xs in got.items()} == expected
        assert all([n for _, n in xs] == list(range(1, len(xs) + 1)) for xs in got.values())


def test_rank_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    ranked = rank_in_group(df, [], ["x"], "n", 50)
    assert ranked.filter("n <> x + 1").count() == 0 and ranked.count() == 1000


def test_lists_come_in_parts(spark):
    rows, df = skewed(spark)
    whole = {r.g: r.vs for r in ordered_list(df, ["g"], "o", ["o", "v"], "vs").collect()}
    parts = ordered_list(df, ["g"], "o", ["o", "v"], "vs", limit=16).orderBy("part").collect()
    joined = {}
    for r in parts:
        assert len(r.vs) <= 16
        joined.setdefault(r.g, []).extend(r.vs)
    assert joined == whole
    assert len([r for r in parts if r.g == "hot"]) > 30


def test_distinct_lists(spark):
    rows, df = skewed(spark)
    got = {r.g: r.vs for r in distinct_sorted(df, ["g"], "v", "vs").collect()}
    assert got == {g: sorted({v for h, _, v in rows if h == g}) for g in {r[0] for r in rows}}
    ordered = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 9, "y")], "g string, p int, v string")
    assert distinct_first_seen(ordered, ["g"], "v", "p", "vs").first().vs == ["y", "x"]


def test_nest_keeps_empty_parents_and_parts(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "k string")
    members = spark.createDataFrame([("a", i) for i in range(10)] + [("c", 1)], "k string, m int")
    got = nest(parents, ["k"], 4, ms=(members, F.col("m"), ["m"])).orderBy("k", "part").collect()
    assert [(r.k, r.part, r.ms) for r in got] == [("a", 0, [0, 1, 2, 3]), ("a", 1, [4, 5, 6, 7]), ("a", 2, [8, 9]), ("b", 0, [])]


def test_densify_by_id(spark):
    df = spark.createDataFrame([("t", "id", 3), ("t", "email", 9)], "t string, name string, ordinal int")
    assert {r.name: r.ordinal for r in densify(df, ["t"], ["name"]).collect()} == {"email": 1, "id": 2}


def brute_names(rows):
    out = []
    for group in {r[1] for r in rows}:
        mine = sorted(r for r in rows if r[1] == group)
        taken, number = {r[2] for r in mine if r[2]}, 0
        for i, _, name in mine:
            if not name:
                while f"c{number or ''}" in taken:
                    number += 1
                name, number = f"c{number or ''}", number + 1
            out.append((i, group, name))
    return sorted(out)


def test_default_names(spark):
    rnd = random.Random(3)
    rows = [(i, f"t{i % 3}", rnd.choice([None, "", "c", "c1", "c2", "c7", "c9", "other", "c01", "cx"])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, t string, name string").withColumn("stem", F.lit("c"))
    for limit in (None, 10):
        got = default_names(df, ["t"], "name", "stem", ["i"], limit).select("i", "t", "name").collect()
        assert sorted(map(tuple, got)) == brute_names(rows)


def test_unnamed_checks(spark):
    rows = [(1, "metrics", "metrics_total_check"), (2, "metrics", None), (3, "metrics", None)]
    df = spark.createDataFrame(rows, "i int, t string, name string").withColumn("stem", F.concat("t", F.lit("_check")))
    got = {r.i: r.name for r in default_names(df, ["t"], "name", "stem", ["i"]).collect()}
    assert got == {1: "metrics_total_check", 2: "metrics_check", 3: "metrics_check1"}


def test_gaps(spark):
    df = spark.createDataFrame([(v,) for v in (1, 3, 5, 11, 13, 13, None)], "v bigint")
    assert sorted(map(tuple, sequence_gaps(df, "v", 2, 3).collect())) == [(7, 9, 2)]


def test_one_answer_at_every_size(spark, monkeypatch):
    """Ties in the order, nulls, and value columns in another order than the table's."""
    rows = [("g" if i % 4 else "h", i % 5 or None, f"b{i % 7}", f"a{i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, b string, a string").repartition(7)
    parents = df.select("k").distinct()

    def answers():
        ranks = [tuple(r) for r in rank_in_group(df, ["k"], ["o"], "n").collect()]
        lists = [(r.k, r.part, r.vs) for r in ordered_list(df, ["k"], "b", ["o"], "vs").collect()]
        nested = [(r.k, r.part, r.ms) for r in nest(parents, ["k"], ms=(df, F.struct("a", "b"), ["o"])).collect()]
        return sorted(ranks, key=repr), sorted(lists), sorted(nested)

    plain = answers()
    assert [(k, part, len(vs)) for k, part, vs in plain[1]] == [("g", 0, 225), ("h", 0, 75)]
    monkeypatch.setattr(groups, "HOT_GROUP_ROWS", 20)
    assert answers() == plain
