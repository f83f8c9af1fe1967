"""Types, names and texts by example."""

from pyspark.sql import functions as F

from palimpsest.functions.described_types import display_type, normal_type, type_parts
from palimpsest.functions.names import default_namespace, is_hash, is_ref, object_id, safe_name, unqualify
from palimpsest.functions.texts import canonical_default, canonical_text, collapse_space, screen_text, split_top_level
from palimpsest.operators.corpus import depends_on, extract_references
from palimpsest.operators.governance import narrows


def each(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, expression, cases):
    assert dict(zip(cases, each(spark, expression, list(cases)))) == cases


def test_types_as_written(spark):
    """Aliases, modifiers inside and behind, array marks, quoted and qualified names; case counts; null where a part is missing."""
    modifiers = {"decimal ( 6 , 3 )": "numeric(6,3)", "char varying": "char varying", "time(2) with time zone": "timetz(2)", "bit varying(12)": "varbit(12)", "REAL": "REAL"}
    arrays = {"real[]": "float4[]", "integer[] []": "int4[][]", "timestamp(6) without time zone[]": "timestamp(6)[]"}
    names = {"ledger.entry_kind": "entry_kind", '"Entry Kind"': "Entry Kind", "entry_kind": "entry_kind"}
    broken = {"\t": None, "(4)": None, "[]": None, "decimal(6": None, "ledger.": None}
    check(spark, lambda c: normal_type(c, "ddl"), modifiers | arrays | names | broken)


def test_types_of_a_catalog_and_back(spark):
    """A spelling shown by a catalog comes back from its normal form, with modifiers or one array mark; an array type shows no modifiers."""
    shown = ["smallint", "integer", "double precision", "character varying[]", "timestamp with time zone", "numeric(6,3)", "uuid", "entry_kind"]
    normal = each(spark, lambda c: normal_type(c, "catalog"), shown)
    assert each(spark, display_type, normal) == shown and len(set(normal)) == len(shown)
    assert each(spark, display_type, ["numeric(6,3)[]"]) == ["numeric[]"]
    assert each(spark, lambda c: normal_type(c, "catalog"), ["  ", "numeric(6"]) == [None, None]


def test_type_parts(spark):
    df = spark.createDataFrame([("int8[]",), ("numeric(10,2)",), ("user_role",)], "t string")
    got = {r.t: r for r in type_parts(df, "t").collect()}
    assert got["int8[]"].is_builtin and got["int8[]"].is_array and got["int8[]"].element_type == "int8"
    assert got["numeric(10,2)"].type_modifiers == "(10,2)" and got["numeric(10,2)"].type_base == "numeric"
    assert not got["user_role"].is_builtin and got["user_role"].array_of == "user_role[]"


def test_names(spark):
    check(spark, unqualify, {' "public.users" ': "users", "a.b.c": "c", "x": "x", "public.": ""})
    check(spark, safe_name, {"tbl:public/users": "tbl_public_users", "": "unknown", "a..b c\\d": "a_b_c_d"})
    check(spark, lambda c: default_namespace(c), {"": "public", "app": "app"})
    check(spark, lambda c: object_id("column", c, F.lit("t"), F.lit("m")), {"": "col:public.t.m", "app": "col:app.t.m"})
    check(spark, is_hash, {"a" * 64: True, "A" * 64: False, "a" * 63: False, "a" * 64 + "\n": False})
    good = ["refs/heads/main", "refs/heads/feature/x", "refs/tags/v1"]
    bad = ["main", "refs/main", "refs/heads/", "refs/heads/a/", "refs/heads//a", "refs/heads/../a", "refs/heads/./a", "refs\\heads/a", "refs/tags/a/."]
    assert each(spark, is_ref, good) == [True] * 3 and each(spark, is_ref, bad) == [False] * len(bad)


def test_screening(spark):
    cases = {
        "   ": "empty", "\\connect other": "\\", "COPY users FROM STDIN": "copy", "create database other": "create database", "drop database;": "drop database",
        "CREATE TABLE public.users (id bigint);": None, "drop table if exists users;": None, "drop database_x": None, "copy_user from stdin": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.problem for r in screen_text(df, "t").collect()} == cases


def test_spacing(spark):
    assert each(spark, lambda c: collapse_space(c, 5), ["  a \n b\t", "abcdefg"]) == ["a b", "abcde..."]


def test_canonical_text(spark):
    """Texts that differ in one thing that does not count have one form; what is quoted counts as written."""
    want = "select sku, qty from stock where bin = 'A 1' and qty in (4, 5)"
    same = [
        want,
        "SELECT sku,qty FROM public . stock WHERE bin = 'A 1' AND qty IN (4 ,5) ;;",
        "select sku, qty -- amounts\nfrom stock /* shelves */ where bin = 'A 1'::varchar(3) and qty::bigint in ( 4, 5 )",
        "\n\tselect sku::text, qty::timestamp(2) with time zone from stock where bin = 'A 1'::shop.bin_name[] and qty in (4,5)\n",
    ]
    assert each(spark, canonical_text, same) == [want] * len(same)
    kept = ["'Don''t /* CUT */ ;'", '"Bin No" || "a""::B"']
    assert each(spark, canonical_text, [f"SELECT {x} ;" for x in kept]) == [f"select {x}" for x in kept]
    assert each(spark, canonical_text, ["A > $1 AND B < $2::int8", "US$ = Cost"]) == ["a > $1 and b < $2", "us$ = cost"]


def test_canonical_default(spark):
    """Literals and null carry the column's type whether or not they were written with it; calls and numbers stay."""
    literals = [(f"'{x}'{cast}", "varchar(9)", f"'{x}'::character varying(9)") for x in ("Bin 7", "", "it''s") for cast in ("", "::varchar", "::character varying(9)")]
    others = [
        ("Null", "entry_kind", "null::entry_kind"), ("-3.5", "numeric(6,3)", "-3.5"), ("FALSE", "bool", "false"), ("Clock( )", "timestamptz", "clock()"),
        (None, "int4", ""), (" nextval( 'ledger.entry_no'::regclass ) ", "int8", "nextval('entry_no'::regclass)"), ("'a' || 'b'", "text", "'a' || 'b'"),
    ]
    df = spark.createDataFrame(literals + others, "e string, t string, want string")
    got = df.select("want", canonical_default(F.col("e"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_arguments(spark):
    check(spark, split_top_level, {"": [], "integer": ["integer"], "integer, text": ["integer", "text"], "numeric(10, 2), text[]": ["numeric(10, 2)", "text[]"], "f(a, (b, c)), [1,2] ": ["f(a, (b, c))", "[1,2]"]})


def test_references(spark):
    text = 'select * from public."Users" u join app.orders on true join users where x in (select 1 from  Orders)'
    df = spark.createDataFrame([(1, text)], "i int, t string")
    assert [r.name for r in extract_references(df, ["i"], "t").orderBy("position").collect()] == ["users", "orders"]


def test_view_dependencies(spark):
    views = spark.createDataFrame([("public", "active", "select id from users"), ("public", "all", "select id from active"), ("public", "constant", "select 1")], "nspname string, relname string, definition string")
    relations = spark.createDataFrame([("public", "tbl:public.users"), ("public", "view:public.active"), ("other", "tbl:public.active")], "nspname string, relation_id string")
    got = {r.view_id: r.depends_on for r in depends_on(views, relations).collect()}
    assert got == {"view:public.active": ["tbl:public.users"], "view:public.all": ["view:public.active"], "view:public.constant": []}


def test_narrowing(spark):
    cases = [("int8", "int4", True), ("int4", "int8", False), ("varchar(20)", "varchar(10)", True), ("varchar(10)", "varchar", False), ("varchar", "varchar(5)", True), ("text", "int4", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.filter(narrows(F.col("a"), F.col("b")) != F.col("want")).isEmpty()
