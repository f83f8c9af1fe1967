"""Walks against a queue on random graphs, deep lines, refs and revisions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import history as H, refs as R, sections


def queue_walk(parents, start):
    seen, order, queue = set(), [], deque([start])
    while queue:
        sha = queue.popleft()
        if sha in seen:
            continue
        seen.add(sha)
        order.append(sha)
        queue.extend(parents.get(sha, []))
    return order


def random_graphs(count, size, seed):
    rnd = random.Random(seed)
    graphs = {}
    for repo in range(count):
        parents = {}
        for i in range(1, size):
            k = rnd.choice([1, 1, 1, 1, 2, 3, 0])
            pool = range(max(0, i - 5), i)
            parents[f"{repo}-{i}"] = [f"{repo}-{p}" for p in rnd.sample(pool, min(k, len(pool)))]
        parents[f"{repo}-0"] = []
        graphs[repo] = parents
    return graphs


def frames(spark, graphs):
    rows = [(r, sha, ps) for r, g in graphs.items() for sha, ps in g.items()]
    commits = spark.createDataFrame(rows, "repo_id int, sha string, parents array<string>")
    return commits.select("repo_id", "sha"), H.edges_of(commits)


def no_refs(spark):
    return spark.createDataFrame([], "repo_id int, full string, sha string")


@pytest.mark.parametrize("few, small, section", [(0, 0, 12), (10_000, 45, 25), (10_000, 100_000, None)])
def test_walk_order_equals_queue(spark, monkeypatch, few, small, section):
    graphs = random_graphs(12, 40, 11)
    commits, edges = frames(spark, graphs)
    starts = [(r, f"{r}-{n}") for r in graphs for n in (39, 31)]
    sdf = spark.createDataFrame(starts, "repo_id int, start string")
    monkeypatch.setattr(sections, "BROADCAST_ROWS", few)
    monkeypatch.setattr(sections, "MAX_PIECES", 3)
    monkeypatch.setattr(sections, "STRIPS", 7)
    got = {}
    for r in H.bfs_rank(H.walk(edges, sdf, None, small, section)).orderBy("rank").collect():
        got.setdefault((r.repo_id, r.start), []).append(r.sha)
    assert got == {(r, s): queue_walk(graphs[r], s) for r, s in starts}
    limited = {}
    for r in H.log(commits, edges, sdf, no_refs(spark), 5, small, section).orderBy("rank").collect():
        limited.setdefault((r.repo_id, r.start), []).append(r.sha)
    assert limited == {k: v[:5] for k, v in got.items()}


def tangled(seed, n):
    """A graph with cycles, self-loops, repeated parents and names that are no commits."""
    rnd = random.Random(seed)
    return {f"{i}": [f"{rnd.randrange(n + 3)}" for _ in range(rnd.choice([0, 1, 1, 2, 3]))] for i in range(n)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_cycles_and_damaged_histories_equal_queue(spark, small):
    graphs = {r: tangled(r, 25) for r in range(4)} | {99: {"a": ["b"], "b": ["c"], "c": ["a"], "x": []}}
    commits, edges = frames(spark, graphs)
    starts = [(r, s) for r, g in graphs.items() for s in (*list(g)[:2], "none")] + [(99, "x")]
    got = {}
    for r in H.walk(edges, spark.createDataFrame(starts, "repo_id int, start string"), None, small, 15).orderBy("rank").collect():
        got.setdefault((r.repo_id, r.start), []).append((r.rank, r.sha))
    assert got == {(r, s): list(enumerate(queue_walk(graphs[r], s), 1)) for r, s in starts}
    tests = [(r, c, s) for r, g in graphs.items() for s in (*list(g)[:3], "none") for c in (*list(g)[::5], "26", "none")]
    found = {(r.repo_id, r.candidate, r.start): r.is_ancestor for r in H.is_ancestor(commits, edges, spark.createDataFrame(tests, "repo_id int, candidate string, start string"), repo_edges=small).collect()}
    assert found == {(r, c, s): c in queue_walk(graphs[r], s) for r, c, s in tests}
    pairs = [(r, a, b) for r, g in graphs.items() for a in list(g)[:3] for b in (*list(g)[3:6], "none")]
    for r in H.merge_base(commits, edges, spark.createDataFrame(pairs, "repo_id int, left string, right string"), small).collect():
        met = [s for s in queue_walk(graphs[r.repo_id], r.left) if s in queue_walk(graphs[r.repo_id], r.right)]
        base = next((s for s in met if s in graphs[r.repo_id]), None)
        assert (r.base, r.reason) == (base, None if base else "missing commit" if met else "no common ancestor")


def test_merges_take_few_rounds(spark):
    """2,000 commits with a merge each: rounds follow the sections, and what is kept of a commit does not grow."""
    n = 2000
    graph = {str(i): [str(p) for p in (i - 1, i - 2 - i % 3) if p >= 0] for i in range(n)}
    _, edges = frames(spark, {0: graph})
    rounds = []
    rows = sections.walk(edges, spark.createDataFrame([(0, str(n - 1))], "repo_id int, start string"), None, 700, rounds.append).orderBy("rank").collect()
    assert [r.sha for r in rows] == queue_walk(graph, str(n - 1))
    assert len(rounds) <= 40 and rows[0].asDict().keys() == {"repo_id", "start", "sha", "depth", "rank"}


def test_rounds_by_sections_hold_numbers_not_names(spark, monkeypatch):
    """Names are written with the edges and with their numbers; rounds know neither names nor what the names are like."""
    tables, durable = [], sections.durable
    monkeypatch.setattr(sections, "durable", lambda df, *how: tables.append(dict(df.dtypes)) or durable(df, *how))
    edges = [(0, "d", 0, "c"), (0, "d", 0, "b"), (0, "d", 0, "é"), (0, "c", 0, "a"), (0, "b", 0, "a"), (0, "a", 0, None), (0, None, 0, "x"), (1, "d", 0, "c"), (1, "c", 1, "b")]
    frame = spark.createDataFrame(edges + edges[:2], "repo_id int, child string, idx int, parent string")
    starts = spark.createDataFrame([(0, "d"), (1, "d"), (1, "none"), (1, "none")], "repo_id int, start string")
    rows = sections.walk(frame, starts, None, 2).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault((r.repo_id, r.start), []).append((r.sha, r.depth, r["rank"]))
    assert found == {
        (0, "d"): [("d", 0, 1), ("b", 1, 2), ("c", 1, 3), ("é", 1, 4), ("a", 2, 5)], (1, "d"): [("d", 0, 1), ("c", 1, 2), ("b", 2, 3)], (1, "none"): [("none", 0, 1)],
    }
    assert len(tables) > 10 and sum("string" in kinds.values() for kinds in tables) == 2


def test_labels_decide_without_edges(spark):
    graphs = random_graphs(6, 40, 3)
    _, edges = frames(spark, graphs)
    labels = H.reach_labels(edges)
    tests = [(r, f"{r}-{c}", f"{r}-{s}") for r in graphs for c in range(0, 40, 3) for s in range(1, 40, 7)]
    known = H.decide(spark.createDataFrame(tests, "repo_id int, candidate string, start string"), labels).where("is_ancestor is not null").collect()
    assert len(known) > 0.6 * len(tests)
    assert all(r.is_ancestor == (r.candidate in queue_walk(graphs[r.repo_id], r.start)) for r in known)


def test_merge_base_visits_what_lies_between(spark):
    """Two branches of 20 commits on a line of 3,000: no more than the branches is looked at."""
    graph = {str(i): [str(i - 1)] if i else [] for i in range(3000)}
    for side in "lr":
        graph |= {f"{side}{i}": [f"{side}{i - 1}" if i else "2990"] for i in range(20)}
    commits, edges = frames(spark, {0: graph})
    row = H.merge_base(commits, edges, spark.createDataFrame([(0, "l19", "r19")], "repo_id int, left string, right string")).first()
    assert row.base == "2990" and row.visited <= 60


def test_merge_base_and_ancestry_equal_queue(spark):
    graphs = random_graphs(25, 30, 5)
    commits, edges = frames(spark, graphs)
    pairs = [(r, f"{r}-29", f"{r}-{n}") for r in graphs for n in (28, 20)]
    got = {(r.repo_id, r.left, r.right): r.base for r in H.merge_base(commits, edges, spark.createDataFrame(pairs, "repo_id int, left string, right string")).collect()}
    for r, a, b in pairs:
        shared = set(queue_walk(graphs[r], b))
        assert got[(r, a, b)] == next((s for s in queue_walk(graphs[r], a) if s in shared), None)
    tests = [(r, f"{r}-{c}", f"{r}-29") for r in graphs for c in (0, 10, 29)] + [(0, "ghost", "ghost"), (0, "ghost", "0-29")]
    found = H.is_ancestor(commits, edges, spark.createDataFrame(tests, "repo_id int, candidate string, start string")).collect()
    assert len(found) == len(tests)
    for r in found:
        assert r.is_ancestor == (r.candidate == r.start or r.candidate in queue_walk(graphs[r.repo_id], r.start))


@pytest.mark.parametrize("small", [0, 100_000])
def test_deep_line_and_missing_parent(spark, monkeypatch, small):
    monkeypatch.setattr(H, "REPO_EDGES", small)
    depth = 3000
    graph = {0: {f"c{i}": [f"c{i - 1}"] for i in range(depth)}}  # c0 names a parent that is no commit
    commits, edges = frames(spark, graph)
    starts = spark.createDataFrame([(0, f"c{depth - 1}"), (0, "c1500")], "repo_id int, start string")
    log = H.log(commits, edges, starts, no_refs(spark)).filter("start = 'c2999'")
    assert log.filter("not missing and rank <> 3000 - cast(substring(sha, 2) as int)").isEmpty()
    assert [(r.sha, r.rank) for r in log.filter("missing").collect()] == [("c-1", depth + 1)]


def test_labels(spark):
    rows = [(1, "refs/heads/a", "x"), (1, "refs/heads/b", "x"), (1, "refs/tags/t", "x"), (1, "refs/tags/v1", "y"), (1, "refs/tags/v0", "y")]
    got = {r.sha: r.ref for r in H.ref_labels(spark.createDataFrame(rows, "repo_id int, full string, sha string")).collect()}
    assert got == {"x": "refs/heads/b", "y": "refs/tags/v0"}


def repo(spark):
    first = "ab" * 32
    refs = spark.createDataFrame([(1, "refs/heads/main", first), (1, "refs/heads/feature/x", first), (1, "refs/tags/v1", first)], "repo_id int, full string, sha string")
    heads = spark.createDataFrame([(1, "refs/heads/main", None), (2, "refs/heads/none", None), (3, None, first)], "repo_id int, ref string, sha string")
    commits = spark.createDataFrame([(1, first), (1, "cd" * 32)], "repo_id int, sha string")
    return first, refs, heads, commits


def test_revisions(spark):
    first, refs, heads, commits = repo(spark)
    good = ["HEAD", "main", "refs/heads/main", "heads/main", "v1", "tags/v1", "refs/tags/v1", first, first[:10]]
    bad = {"": "empty", "nope": "unknown", "abc": "unknown", "not-a-hash-but-long-enough": "unknown"}
    revs = spark.createDataFrame([(1, r) for r in [*good, *bad]], "repo_id int, revision string")
    got = {r.revision: (r.sha, r.status) for r in R.resolve_revisions(revs, refs, heads, commits).collect()}
    assert got == {r: (first, "ok") for r in good} | {r: (None, s) for r, s in bad.items()}


def test_rename_delete_heads(spark):
    first, refs, heads, commits = repo(spark)
    moves = spark.createDataFrame([(1, "refs/heads/main", "refs/heads/trunk"), (1, "refs/heads/feature/x", "refs/heads/main"), (1, "refs/heads/gone", "refs/heads/n"), (1, "refs/heads/main", "refs/tags/m")], "repo_id int, source string, target string")
    new_refs, new_heads, refused = R.rename_refs(refs, heads, moves)
    assert sorted(r.full for r in new_refs.collect()) == ["refs/heads/feature/x", "refs/heads/trunk", "refs/tags/v1"]
    assert new_heads.filter("repo_id = 1").first().ref == "refs/heads/trunk"
    assert sorted(r.reason for r in refused.collect()) == ["missing", "not a branch", "taken"]
    left, failed = R.delete_refs(refs, spark.createDataFrame([(1, "refs/tags/v1"), (1, "refs/tags/v2"), (1, "v1")], "repo_id int, full string"))
    assert left.count() == 2 and sorted(r.reason for r in failed.collect()) == ["invalid ref", "missing"]
    states = {r.repo_id: (r.state, r.sha) for r in R.resolve_heads(heads, refs).collect()}
    assert states == {1: ("symbolic", first), 2: ("unborn", None), 3: ("detached", first)}
    assert [r.name for r in R.list_refs(refs, "heads").collect()] == ["feature/x", "main"]


def test_ambiguous_prefix(spark):
    a, b = "abcdef0" + "1" * 57, "abcdef0" + "2" * 57
    commits = spark.createDataFrame([(1, a), (1, b)], "repo_id int, sha string")
    revs = spark.createDataFrame([(1, "abcdef0"), (1, "abcdef01"), (1, "abcdef"), (1, "abcdef03")], "repo_id int, revision string")
    got = {r.revision: (r.match, r.status) for r in R.resolve_prefix(revs, commits).collect()}
    assert got == {"abcdef0": (None, "ambiguous"), "abcdef01": (a, "ok"), "abcdef": (None, "unknown"), "abcdef03": (None, "unknown")}


@pytest.mark.parametrize("small", [0, 100_000])
def test_ancestors_that_are_no_commits(spark, monkeypatch, small):
    monkeypatch.setattr(H, "REPO_EDGES", small)
    commits, edges = frames(spark, {1: {"a": ["b", "gone"], "b": ["lost"]}})
    starts = spark.createDataFrame([(1, "a"), (1, "none")], "repo_id int, start string")
    found = {(r.start, r.sha, r.missing) for r in H.ancestors(commits, edges, starts).collect()}
    assert found == {("a", "a", False), ("a", "b", False), ("a", "gone", True), ("a", "lost", True), ("none", "none", True)}
    pairs = spark.createDataFrame([(1, "lost", "a"), (1, "b", "a"), (1, "other", "a")], "repo_id int, candidate string, start string")
    assert {r.candidate: r.is_ancestor for r in H.is_ancestor(commits, edges, pairs).collect()} == {"lost": True, "b": True, "other": False}


def test_pairs_of_small_repositories_travel_once(spark):
    edges = spark.createDataFrame([(1, "b", 0, "a"), (1, "c", 0, "b")], "repo_id int, child string, idx int, parent string")
    commits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "repo_id int, sha string")
    rows = [(1, "a", "c"), (1, "a", "c"), (1, "c", "a"), (1, None, "a"), (1, "a", None), (None, "a", "a"), (2, "x", "x"), (2, "x", "y")]
    pairs = spark.createDataFrame(rows, "repo_id int, candidate string, start string")
    found = H.is_ancestor(commits, edges, pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
    expected = sorted(map(str, zip(rows, [True, True, False, False, False, False, True, False])))
    for how in ({}, {"labels": H.reach_labels(edges)}, {"repo_edges": 0}):
        assert sorted(str(((r[0], r[1], r[2]), r[3])) for r in H.is_ancestor(commits, edges, pairs, **how).collect()) == expected
    more = pairs.withColumn("note", F.lit("n"))
    assert sorted(str(((r[0], r[1], r[2]), r[4])) for r in H.is_ancestor(commits, edges, more).collect()) == expected
