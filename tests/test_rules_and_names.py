"""Generated names, gaps, kinds, risks and broken texts on small inputs, against plain Python where a rule is long."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.texts import canonical_text, text_problem
from palimpsest.operators import constraints as D, governance as G, groups, rules as C
from palimpsest.operators.groups import rank_in_group
from palimpsest.operators.ordinals import default_names


def one_after_another(rows):
    """Explicit names first, then the nameless of a group in order."""
    out = []
    for group in {r[1] for r in rows}:
        mine = sorted(r for r in rows if r[1] == group) if group is not None else sorted((r for r in rows if r[1] is None), key=lambda r: r[0])
        taken = {n for _, _, _, n in mine if n}
        for i, _, stem, name in mine:
            if not name and stem is not None:
                number = 0
                while (name := f"{stem}{number or ''}") in taken:
                    number += 1
                taken.add(name)
            out.append((i, group, name or None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_names_are_unique_whatever_the_stems(spark, seed):
    rnd = random.Random(seed)
    stems = ["c", "c1", "c11", "c2", "d", "d0", "e"]
    names = [None, None, None, "", "c", "c1", "c2", "c12", "c01", "d", "d0", "d01", "other", "e1"]
    rows = [(i, rnd.choice(["g", "h", None]), rnd.choice(stems + [None] * (i % 40 == 0)), rnd.choice(names)) for i in range(220)]
    df = spark.createDataFrame(rows, "i int, t string, stem string, name string")
    for limit in (None, 15):
        got = default_names(df, ["t"], "name", "stem", ["i"], limit)
        assert got.columns == df.columns
        assert sorted(((r.i, r.t, r.name or None) for r in got.collect()), key=repr) == one_after_another(rows)


def test_names_given_under_another_stem(spark):
    df = spark.createDataFrame([(1, "g", "t_b_check", "t_a_check"), (2, "g", "t_a_check", None), (3, "h", "x", None), (4, "h", "x", None), (5, "h", "x1", None)], "i int, t string, stem string, name string")
    assert [r.name for r in default_names(df, ["t"], "name", "stem", ["i"]).orderBy("i").collect()] == ["t_a_check", "t_a_check1", "x", "x1", "x11"]


def test_ranks_of_tables_with_maps(spark, monkeypatch):
    df = spark.createDataFrame([("g", i % 3, {"a": i}) for i in range(40)], "k string, o int, m map<string,int>")
    plain = sorted((r.n, r.o, r.m["a"]) for r in rank_in_group(df, ["k"], ["o"], "n").collect())
    assert [n for n, _, _ in plain] == list(range(1, 41)) and [o for _, o, _ in plain] == sorted(o for _, o, _ in plain)
    monkeypatch.setattr(groups, "HOT_GROUP_ROWS", 5)
    assert sorted((r.n, r.o, r.m["a"]) for r in rank_in_group(df, ["k"], ["o"], "n").collect()) == plain


def test_gaps_start_where_the_values_do(spark):
    df = spark.createDataFrame([(v,) for v in (1, 3, 5, 11, 13, None)], "v bigint")
    rows = lambda **how: sorted(map(tuple, D.sequence_gaps(df, "v", **how).collect()))
    assert rows(increment=2) == [(7, 9, 2)] == rows(increment=2, start=1) and rows(increment=2, start=0) == []
    assert rows(increment=4) == [(9, 9, 1)] and rows() == [(2, 2, 1), (4, 4, 1), (6, 10, 5), (12, 12, 1)]


def test_gaps_of_many_sequences(spark):
    rnd = random.Random(2)
    rules = {k: (rnd.randint(-5, 5), rnd.choice([-3, -1, 1, 2, 5]), -40, 10 * k) for k in range(1, 8)}
    values = [(rnd.choice([*rules, 99, None]), rnd.randint(-60, 80)) for _ in range(900)] + [(1, None)]
    expected = []
    for k, (start, step, low, high) in rules.items():
        own = sorted({v for key, v in values if key == k and v is not None and low <= v <= high and (v - start) % abs(step) == 0})
        expected += [(k, a + abs(step), b - abs(step), (b - a) // abs(step) - 1) for a, b in zip(own, own[1:]) if b - a > abs(step)]
    df = spark.createDataFrame(values, "k int, v int")
    sequences = spark.createDataFrame([(k, *r) for k, r in rules.items()], "k int, start int, increment int, min_value int, max_value int")
    assert sorted(map(tuple, D.gaps_by_sequence(df, "k", "v", sequences).collect())) == sorted(expected)


@pytest.mark.parametrize(
    "before, after, lost",
    [
        ("numeric(10,2)", "numeric(10,4)", True), ("numeric(10,4)", "numeric(10,2)", True), ("numeric(10,2)", "numeric(12,4)", False), ("numeric(10)", "numeric", False), ("numeric", "numeric(10)", True),
        ("varchar(255)[]", "varchar(10)[]", True), ("varchar(10)[]", "varchar(255)[]", False), ("varchar(10)", "text", False), ("text", "varchar(10)", True), ("bpchar", "bpchar(4)", False), ("bpchar(4)", "bpchar", True),
        ("int4", "numeric", False), ("int4", "numeric(9)", True), ("int4", "numeric(10)", False), ("int8", "float8", True), ("int2", "int8", False), ("int8", "int2", True), ("int4", "text", True),
        ("timestamp(3)", "timestamp", False), ("timestamp", "timestamp(3)", True), ("int4[]", "int4", True), ("a.b", "a.b", False),
    ],
)
def test_type_changes(spark, before, after, lost):
    df = spark.createDataFrame([(before, after)], "b string, a string")
    assert df.select(G.narrows(F.col("b"), F.col("a"))).first()[0] is lost


def test_kinds_of_values(spark):
    given = ['{"k":', '{"k": 1.5}', '{"k": 1}', '{"k": "1"}', '{"k": null}', "{}", None, "[1]", '{"k": 1e2}']
    df = spark.createDataFrame(list(enumerate(given)), "i int, j string")
    found = {(int(r.object_id), r.field, r.detail) for r in C.value_kinds(df, F.col("i"), "j", {"k": "DOUBLE"}).collect()}
    assert found == {(0, "j", "malformed"), (3, "k", "wrong kind")}
    assert {int(r.object_id) for r in C.value_kinds(df, F.col("i"), "j", {"k": "BIGINT"}).collect()} == {0, 1, 3, 8}


def test_dollar_quotes_and_broken_texts(spark):
    texts = {
        "$$Hello  World$$": None, "select $tag$ A $$ b $tag$ X": None, "select 'open": "open text", "select 'it''s": "open text", 'select "x': "open name", "a /* b": "open comment",
        "select $$open": "open dollar text", "select $a$ x $b$": "open dollar text", "a$$b": None, "-- it's\nx": None, "/* ' */ 1": None, "'--' 1": None, "price $5": None, "é$$ x": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_problem(F.col("t")).alias("p"), canonical_text(F.col("t")).alias("c"))
    rows = {r.t: r for r in df.collect()}
    assert {t: r.p for t, r in rows.items()} == texts
    assert rows["$$Hello  World$$"].c == "$$Hello  World$$" and rows["select $tag$ A $$ b $tag$ X"].c == "select $tag$ A $$ b $tag$ x"
