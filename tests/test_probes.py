"""Inputs that once gave wrong answers."""

from palimpsest.operators import constraints, fingerprints, governance, groups, history, refs
from palimpsest.sources.conflicts import SCHEMA, clear_conflicts, read_conflicts, write_conflicts
from palimpsest.sources.migrations import write_migrations
from palimpsest.sources.strict_json import strict_json

A, B = "a" * 64, "b" * 64
R = "repo_id int, full string, sha string"


def test_text_that_closes_the_wrapper_is_malformed(spark):
    texts = ['{"k": 1}] junk', '{"k":1}],{"z":2', '{"k":1}}', '{"k":1},"x":{"k":2}', '{"k": 1}']
    found = strict_json(spark.createDataFrame([(t,) for t in texts], "j string"), "j", ["k"])
    assert {r.j for r in found.collect()} == set(texts[:-1])


def test_repeated_updates_are_refused(spark):
    have = spark.createDataFrame([(1, "refs/heads/m", A)], R)
    commits = spark.createDataFrame([(1, A), (1, B)], "repo_id int, sha string")
    updates = spark.createDataFrame([(1, "refs/heads/m", A), (1, "refs/heads/m", B), (1, "refs/heads/n", B)], R)
    new, refused = refs.upsert_refs(have, updates, commits)
    assert {(r.full, r.sha) for r in new.collect()} == {("refs/heads/m", A), ("refs/heads/n", B)} and new.count() == 2
    assert [r.reason for r in refused.collect()] == ["repeated", "repeated"]
    heads = spark.createDataFrame([(1, "refs/heads/m", None)], "repo_id int, ref string, sha string")
    moved = spark.createDataFrame([(1, "refs/heads/n", None), (1, None, B)], "repo_id int, ref string, sha string")
    assert refs.set_heads(heads, moved, commits)[0].count() == 1


def test_a_branch_moves_once(spark):
    have = spark.createDataFrame([(1, "refs/heads/m", A)], R)
    heads = spark.createDataFrame([(1, "refs/heads/m", None)], "repo_id int, ref string, sha string")
    moves = spark.createDataFrame([(1, "refs/heads/m", "refs/heads/b"), (1, "refs/heads/m", "refs/heads/a")], "repo_id int, source string, target string")
    new, followed, refused = refs.rename_refs(have, heads, moves)
    assert [r.full for r in new.collect()] == ["refs/heads/a"] and [r.ref for r in followed.collect()] == ["refs/heads/a"]
    assert [(r.target, r.reason) for r in refused.collect()] == [("refs/heads/b", "missing")]


def test_a_missing_commit_is_no_base(spark):
    edges = spark.createDataFrame([(1, "x", 0, "ghost"), (1, "y", 0, "ghost")], "repo_id int, child string, idx int, parent string")
    commits = spark.createDataFrame([(1, "x"), (1, "y")], "repo_id int, sha string")
    row = history.merge_base(commits, edges, spark.createDataFrame([(1, "x", "y")], "repo_id int, left string, right string")).first()
    assert row.base is None and row.reason == "missing commit"


def test_gaps_on_the_grid(spark):
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert [tuple(r) for r in constraints.sequence_gaps(values(1, 2, 5), "v", 2, start=1).collect()] == [(3, 3, 1)]
    assert [r.missing for r in constraints.sequence_gaps(values(1, 9007199254740997), "v").collect()] == [9007199254740995]


def test_missing_checksums_are_tampered(spark):
    rows = spark.createDataFrame([(A, "x", None), (B, None, A)], "migration_id string, up_sql string, checksum string")
    assert governance.tampered(rows).count() == 2


def test_names_are_told_apart(spark):
    roots = {fingerprints.table_hash(spark.createDataFrame([(1, 2)], [f"{a}", f"{b}"])).first().root_hash for a, b in (("a|b", "c"), ("a", "b|c"))}
    assert len(roots) == 2


def test_merge_ids_of_any_characters(spark, tmp_path):
    path, merge = str(tmp_path / "c"), "refs/heads/x=1"
    rows = spark.createDataFrame([("o", "field", None, None, None, [], "m")], SCHEMA.rsplit(",", 1)[0])
    write_conflicts(rows, merge, path)
    write_conflicts(rows, merge, path)
    assert read_conflicts(spark, path, merge).count() == 1
    clear_conflicts(spark, merge, path)
    assert read_conflicts(spark, path).isEmpty()


def test_refused_migrations_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(A, "u", "d"), ("nope", "u", "d")], "migration_id string, up_sql string, down_sql string")
    assert [r.migration_id for r in write_migrations(rows, str(tmp_path / "m")).collect()] == ["nope"]


def test_no_single_task_above_the_count_of_groups(spark):
    """The sizes of all groups are not pulled into one task."""
    seen = []
    original, groups.durable = groups.durable, lambda df: seen.append(df._jdf.queryExecution().toString()) or original(df)
    try:
        groups.split_hot(spark.range(100).selectExpr("id % 7 as k"), ["k"], 10)
    finally:
        groups.durable = original
    assert seen and not any("Coalesce 1" in plan or "Repartition 1" in plan for plan in seen)
