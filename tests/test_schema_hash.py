"""Hashes of whole schemas: order does not matter, every field does."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.schema_hash import IN_NAMESPACE, IN_TABLE, namespace_hashes, schema_hash, table_hashes


def sample(spark, **changed):
    """A small schema; `changed` replaces a field of the first member of a kind: kind__field=value."""
    rows = {
        "columns": [("s", "t", "c1", "id", "int8", False, "nextval('q')", True, None), ("s", "t", "c2", "a", "text", True, None, False, "s"), ("s", "u", "c3", "b", "text", True, "", None, "")],
        "constraints": [("s", "t", "k1", "fk", "fk", ["a"], None, "s.u", ["b"]), ("s", "t", "k2", "ck", "check", [], "a > 1", None, None)],
        "indexes": [("s", "t", "i1", "ix", ["a"], "btree", True, "a is not null")],
        "views": [("s", "v1", "v", "select 1", ["t"])],
        "enums": [("s", "e1", "e", ["x", "y"])],
        "sequences": [("s", "q1", "q", "int8", 1, 1, 1, 100, False)],
        "functions": [("s", "f1", "f", ["a int"], "int4", "sql", "select 1")],
    }
    frames = {}
    for kind, listed in rows.items():
        fields = (IN_TABLE | IN_NAMESPACE)[kind].fields
        keys = ["nspname", "relname"] if kind in IN_TABLE else ["nspname"]
        names = [*keys, *fields]
        first = list(listed[0])
        for what, value in changed.items():
            own, field = what.split("__")
            if own == kind:
                first[names.index(field)] = value
        frames[kind] = spark.createDataFrame([tuple(first), *listed[1:]], ", ".join([*[f"{k} string" for k in keys], *[f"`{f}` {t}" for f, t in fields.items()]]))
    return frames


def whole(spark, frames):
    tables = spark.createDataFrame([("s", "t", "tt", "t"), ("s", "u", "tu", "u")], "nspname string, relname string, id string, name string")
    nodes = table_hashes(tables, **{k: frames[k] for k in IN_TABLE})
    spaces = spark.createDataFrame([("s", "ns:s"), ("empty", "ns:empty")], "nspname string, id string")
    return schema_hash(namespace_hashes(spaces, nodes, **{k: frames[k] for k in IN_NAMESPACE})).first()


def test_order_and_absent_fields_do_not_matter(spark):
    plain = whole(spark, sample(spark))
    assert plain.namespaces == 2
    assert whole(spark, {k: df.orderBy(F.desc("id")).repartition(3) for k, df in sample(spark).items()}) == plain
    absent = whole(spark, sample(spark, columns__generated="", constraints__expression="", columns__default="nextval('q')"))
    assert absent == plain


@pytest.mark.parametrize(
    "change",
    [
        {"constraints__referenced_table": "s.v"}, {"constraints__referenced_columns": ["c"]}, {"columns__nullable": True}, {"columns__is_identity": False}, {"columns__generated": "s"},
        {"indexes__unique": False}, {"indexes__predicate": None}, {"views__depends_on": []}, {"enums__values": ["y", "x"]}, {"sequences__max_value": 99}, {"functions__definition": "select 2"}, {"functions__arguments": []},
    ],
)
def test_every_field_matters(spark, change):
    assert whole(spark, sample(spark, **change)).hash != whole(spark, sample(spark)).hash


def test_empty_schema(spark):
    none = spark.createDataFrame([], "nspname string, id string, hash string")
    assert schema_hash(none).first().namespaces == 0
