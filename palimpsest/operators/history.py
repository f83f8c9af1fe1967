"""Walks over the commit graphs of many repositories at once.

Inputs are `commits(repo_id, sha, …)` and `edges(repo_id, child, idx, parent)`. Every shuffle is by
repository, or by section where a repository is large.

**Small repositories** (counted first) are worked on whole inside a task, after one shuffle by
repository: walks, reachability and merge bases there cost no rounds, and a merge base visits only
what lies between the two commits and their base. **Large ones** are walked section by section
(`sections`), in about as many rounds as a walk crosses sections. Both give the same rows, on
cyclic and damaged histories too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions.names import is_hash
from palimpsest.operators import graph_tasks, sections
from palimpsest.session import durable

REPO_EDGES = 100_000
WALK_ROWS = 1_000_000


def edges_of(commits: DataFrame, parents: str = "parents") -> DataFrame:
    """Parent edges of commits that carry their parents as a list."""
    return commits.select("repo_id", F.col("sha").alias("child"), F.posexplode(parents).alias("idx", "parent"))


class Repository:
    """The rows of one repository: parents in order, commits that exist, labels, and what is asked (two texts each)."""

    def __init__(self, name: object) -> None:
        self.name, self.links, self.there, self.asked = name, [], set(), []
        self.labels: graph_tasks.Labels = {}

    def parents(self) -> graph_tasks.Parents:
        out: graph_tasks.Parents = {}
        for child, _, parent in sorted(self.links):
            out.setdefault(child, []).append(parent)
        return out


_EDGE, _COMMIT, _LABEL, _ASKED = range(4)


def _stacked(edges: DataFrame | None, commits: DataFrame | None, labels: DataFrame | None, asked: DataFrame | None) -> DataFrame:
    """What belongs to a repository as rows of one shape: repo_id, kind, a, b, i, j, k."""
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def shaped(df: DataFrame, kind: int, *columns: str) -> DataFrame:
        own = dict(zip("abijk", columns))
        cells = [F.col(own[c]).cast("bigint" if c in "ijk" else "string").alias(c) if own.get(c) else (no_number if c in "ijk" else no_text).alias(c) for c in "abijk"]
        return df.select("repo_id", F.lit(kind).alias("kind"), *cells)

    parts = [
        shaped(df, kind, *columns)
        for df, kind, columns in (
            (edges, _EDGE, ("child", "parent", "idx")), (commits, _COMMIT, ("sha",)), (labels, _LABEL, ("sha", "", "generation", "first", "last")), (asked, _ASKED, ("a", "b")),
        )
        if df is not None
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _per_repository(rows: DataFrame, answer: Callable[[Repository], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """`answer` of each repository of bounded size: one shuffle, and one repository in memory at a time."""
    arrow = to_arrow_schema(schema)

    def repositories(batches: Iterator[pa.RecordBatch]) -> Iterator[Repository]:
        own = None
        for batch in batches:
            for name, kind, a, b, i, j, k in zip(*[batch.column(c).to_pylist() for c in ("repo_id", "kind", "a", "b", "i", "j", "k")]):
                if own is None or name != own.name:
                    if own is not None:
                        yield own
                    own = Repository(name)
                if kind == _ASKED:
                    own.asked.append((a, b))
                elif not own.asked:
                    continue  # questions come first: without one nothing is kept, whatever the size
                elif kind == _EDGE:
                    own.links.append((a, i, b))
                elif kind == _COMMIT:
                    own.there.add(a)
                else:
                    own.labels[a] = (i, j, k)
        if own is not None:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for own in repositories(batches) for row in answer(own))
        while chunk := list(islice(found, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), arrow.types)], schema=arrow)

    # Dealt out by a hash of its own: a union that claims to be partitioned by repository keeps to it no longer once a
    # join below it is turned into a broadcast at run time.
    return rows.repartition(F.xxhash64("repo_id")).sortWithinPartitions("repo_id", F.desc("kind")).mapInArrow(run, schema)


def _schema(df: DataFrame, columns: str) -> T.StructType:
    return T.StructType([df.schema["repo_id"], *T.StructType.fromDDL(columns).fields])


def _split(edges: DataFrame, asked: DataFrame, repo_edges: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Repositories asked for (repo_id, questions) that fit into a task with their questions, and those that do not (None when there are none)."""
    most = REPO_EDGES if repo_edges is None else repo_edges
    begun = asked.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_asked"))
    linked = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_edges"))
    sizes = begun.join(linked, "repo_id", "left").withColumn("_edges", F.coalesce("_edges", F.lit(0)))
    fits = (F.col("_edges") <= most) & (F.greatest(F.col("_edges"), F.lit(1)) * F.col("_asked") <= WALK_ROWS)
    big = durable(sizes.where(~fits).select("repo_id"))
    if big.isEmpty():
        return asked, None
    return asked.join(big, "repo_id", "left_anti"), asked.join(big, "repo_id", "left_semi")


def _of(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the repositories that are asked for."""
    return df.join(asked.select("repo_id").distinct(), "repo_id", "left_semi")


def walk(edges: DataFrame, starts: DataFrame, within: int | None = None, repo_edges: int | None = None, section_edges: int | None = None) -> DataFrame:
    """Commits reachable from each start: repo_id, start, sha, depth, rank (1-based, of a first-in-first-out walk).

    Starts and parents that are no commits appear with their place in the walk, so callers can report them; a cycle is
    walked once round. `within` stops at a distance, enough for a limited log: the n-th commit is never further than
    n - 1 steps away. Repositories of up to `repo_edges` edges stay in one task, larger ones go by sections of about
    `section_edges`; rows are the same.
    """
    starts = starts.filter("start is not null and start <> ''").select("repo_id", "start").distinct()
    small, large = _split(edges, starts, repo_edges)

    def visit(own: Repository) -> Iterator[tuple]:
        parents = own.parents() if own.asked else {}
        for start, _ in own.asked:
            for rank, (sha, depth) in enumerate(graph_tasks.discovery(parents, start, within), 1):
                yield own.name, start, sha, depth, rank

    rows = _stacked(_of(edges, small), None, None, small.select("repo_id", F.col("start").alias("a"), F.lit("").alias("b")))
    walked = _per_repository(rows, visit, _schema(starts, "start string, sha string, depth bigint, rank bigint"))
    if large is None:
        return walked
    own = edges.join(large.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", "child", "idx", "parent")
    by_sections = sections.walk(own, large, within, section_edges or sections.SECTION_EDGES).select(*walked.columns)
    return by_sections if small.isEmpty() else walked.unionByName(by_sections)


def bfs_rank(walked: DataFrame) -> DataFrame:
    """The 1-based discovery rank of each commit in its walk."""
    return walked.select("repo_id", "start", "sha", "rank")


def ref_labels(refs: DataFrame) -> DataFrame:
    """One label per commit: the last branch name, else the first tag name."""
    branch, tag = F.col("full").startswith("refs/heads/"), F.col("full").startswith("refs/tags/")
    return (
        refs.groupBy("repo_id", "sha")
        .agg(F.max(F.when(branch, F.col("full"))).alias("_branch"), F.min(F.when(tag, F.col("full"))).alias("_tag"))
        .select("repo_id", "sha", F.coalesce("_branch", "_tag").alias("ref"))
    )


def decorate_with_refs(log_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Add the label of each commit, null where it has none."""
    return log_rows.join(ref_labels(refs), ["repo_id", "sha"], "left")


def log(
    commits: DataFrame, edges: DataFrame, starts: DataFrame, refs: DataFrame, limit: int = 0, repo_edges: int | None = None, section_edges: int | None = None
) -> DataFrame:
    """Commits in walk order with label; `limit` > 0 keeps the first n of every walk.

    A start or parent that is no commit is a row with `missing` = true.
    """
    ranked = durable(walk(edges, starts, limit if limit > 0 else None, repo_edges, section_edges), "zstd")
    if limit > 0:
        ranked = ranked.filter(F.col("rank") <= limit)
    there = commits.withColumn("_there", F.lit(True))
    rows = ranked.join(there, ["repo_id", "sha"], "left").withColumn("missing", F.col("_there").isNull()).drop("_there")
    return decorate_with_refs(rows, refs)


def ancestors(commits: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Commits reachable from each start, itself included: repo_id, start, sha, missing.

    A start or parent that is no commit is a row with `missing` = true.
    """
    there = commits.select("repo_id", "sha").distinct().withColumn("_there", F.lit(True))
    return walk(edges, starts).join(there, ["repo_id", "sha"], "left").select(
        "repo_id", "start", "sha", F.col("_there").isNull().alias("missing")
    )


def reach_labels(edges: DataFrame, repo_edges: int | None = None) -> DataFrame:
    """repo_id, sha, generation, first, last of each commit and parent: to be kept beside the commits for `is_ancestor`.

    The generation is 1 + the longest way to a root; first..last numbers the commits whose line of first parents leads
    through this one. Names on a cycle, or with one behind them, have no label. Nor have repositories of more than
    `repo_edges` edges; pairs there are decided by a walk.
    """
    small, _ = _split(edges, edges.select("repo_id").distinct(), repo_edges)

    def named(own: Repository) -> Iterator[tuple]:
        for sha, label in graph_tasks.labels(own.parents() if own.asked else {}).items():
            yield own.name, sha, *label

    rows = _stacked(_of(edges, small), None, None, small.select("repo_id", F.lit("").alias("a"), F.lit("").alias("b")))
    return _per_repository(rows, named, _schema(edges, "sha string, generation bigint, first bigint, last bigint"))


def decide(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """`pairs` with `is_ancestor` as far as two labels per pair tell, else null: no walk, and no list of ancestors."""
    c = labels.select("repo_id", F.col("sha").alias("candidate"), F.struct("generation", "first", "last").alias("_c"))
    s = labels.select("repo_id", F.col("sha").alias("start"), F.struct("generation", "first", "last").alias("_s"))
    both = pairs.join(c, ["repo_id", "candidate"], "left").join(s, ["repo_id", "start"], "left")
    on_line = F.col("_s.first").between(F.col("_c.first"), F.col("_c.last"))
    answer = F.when(F.col("candidate") == F.col("start"), True).when(on_line, True).when(F.col("_c.generation") >= F.col("_s.generation"), False)
    return both.withColumn("is_ancestor", answer).select(*pairs.columns, "is_ancestor")


def is_ancestor(commits: DataFrame, edges: DataFrame, pairs: DataFrame, labels: DataFrame | None = None, repo_edges: int | None = None) -> DataFrame:
    """Per (repo_id, candidate, start): is the candidate reachable from, or equal to, the start.

    A parent that is no commit is reachable too. Labels (`reach_labels`; made here if not given) decide most pairs.
    Only the rest walks, from the start and no further than labels leave open. Pairs with a null are false; further columns
    of `pairs` are joined to the answers.
    """
    keys = ["repo_id", "candidate", "start"]
    if sorted(pairs.columns) != sorted(keys) or any(pairs.schema[c].dataType != T.StringType() for c in keys[1:]):
        asked = pairs.select(*keys).where("repo_id is not null and candidate is not null and start is not null").distinct()
        joined = pairs.join(_reached(edges, asked, labels, repo_edges), keys, "left")
        return joined.select(*pairs.columns, F.coalesce("is_ancestor", F.lit(False)).alias("is_ancestor"))
    answers = _reached(edges, pairs.where("repo_id is not null"), labels, repo_edges)
    nowhere = pairs.where("repo_id is null").withColumn("is_ancestor", F.lit(False))
    return answers.unionByName(nowhere).select(*pairs.columns, "is_ancestor")


def _reached(edges: DataFrame, asked: DataFrame, labels: DataFrame | None, repo_edges: int | None) -> DataFrame:
    """repo_id, candidate, start, is_ancestor of each row asked for. Edges and questions of a small repository meet once, in its task, where labels are made if not given."""
    small, large = _split(edges, asked, repo_edges)
    given = labels is not None

    def answer(own: Repository) -> Iterator[tuple]:
        parents = own.parents() if own.asked else {}
        known = own.labels if given else graph_tasks.labels(parents)
        for candidate, start in own.asked:
            yield own.name, candidate, start, candidate is not None and start is not None and graph_tasks.reaches(parents, known, start, candidate)

    rows = _stacked(edges, None, labels, small.select("repo_id", F.col("candidate").alias("a"), F.col("start").alias("b")))
    answers = _per_repository(rows, answer, _schema(asked, "candidate string, start string, is_ancestor boolean"))
    return answers if large is None else answers.unionByName(_reached_large(edges, large, labels, repo_edges))


def _reached_large(edges: DataFrame, pairs: DataFrame, labels: DataFrame | None, repo_edges: int | None) -> DataFrame:
    """The same where a repository or what is asked of it does not fit into a task: labels are joined to the pairs, and only the rest walks."""
    asked = pairs.select("repo_id", "candidate", "start").where("candidate is not null and start is not null").distinct()
    labels = durable(reach_labels(_of(edges, asked), repo_edges) if labels is None else labels)
    settled = durable(decide(asked, labels))
    open_ = settled.where("is_ancestor is null").drop("is_ancestor")
    small, large = _split(edges, open_, repo_edges)
    answers = settled.where("is_ancestor is not null").select("repo_id", "candidate", "start", "is_ancestor")

    def answer(own: Repository) -> Iterator[tuple]:
        parents = own.parents() if own.asked else {}
        for candidate, start in own.asked:
            yield own.name, candidate, start, graph_tasks.reaches(parents, own.labels, start, candidate)

    rows = _stacked(_of(edges, small), None, _of(labels, small), small.select("repo_id", F.col("candidate").alias("a"), F.col("start").alias("b")))
    answers = answers.unionByName(_per_repository(rows, answer, _schema(pairs, "candidate string, start string, is_ancestor boolean")))
    if large is not None:
        reached = sections.distances(_of(edges, large).select("repo_id", "child", "idx", "parent"), large.select("repo_id", "start").distinct(), None, sections.SECTION_EDGES, lambda kind: None)
        hit = large.join(reached.select("repo_id", "start", F.col("sha").alias("candidate"), F.lit(True).alias("_hit")), ["repo_id", "start", "candidate"], "left")
        answers = answers.unionByName(hit.select("repo_id", "candidate", "start", F.col("_hit").isNotNull().alias("is_ancestor")))
    joined = pairs.join(answers, ["repo_id", "candidate", "start"], "left")
    return joined.select("repo_id", "candidate", "start", F.coalesce("is_ancestor", F.lit(False)).alias("is_ancestor"))


def merge_base(commits: DataFrame, edges: DataFrame, pairs: DataFrame, repo_edges: int | None = None) -> DataFrame:
    """Per (repo_id, left, right): the first commit of the left walk that the right one reaches too.

    Null with a reason when nothing is shared, or nothing but names of commits that do not exist. `visited` counts the
    names looked at (null where a repository is too large for one task): in such a task the left walk stops at the base
    and the right side is opened by generation only as deep as the left has come.
    """
    asked = pairs.select("repo_id", "left", "right").where("left <> '' and right <> ''").distinct()
    small, large = _split(edges, asked, repo_edges)

    def answer(own: Repository) -> Iterator[tuple]:
        parents = own.parents() if own.asked else {}
        known = graph_tasks.labels(parents)
        for left, right in own.asked:
            yield own.name, left, right, *graph_tasks.merge_base(parents, known, own.there, left, right)

    rows = _stacked(_of(edges, small), _of(commits, small), None, small.select("repo_id", F.col("left").alias("a"), F.col("right").alias("b")))
    bases = _per_repository(rows, answer, _schema(pairs, "left string, right string, base string, reason string, visited bigint"))
    if large is not None:
        bases = bases.unionByName(_merge_base_large(commits, edges, large))
    joined = pairs.join(bases, ["repo_id", "left", "right"], "left")
    return joined.select(*pairs.columns, "base", F.when(F.col("base").isNull(), F.coalesce("reason", F.lit("no common ancestor"))).alias("reason"), "visited")


def _merge_base_large(commits: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merge bases from two walks by sections."""
    sides = pairs.select("repo_id", F.explode(F.array("left", "right")).alias("start")).distinct()
    walked = durable(sections.walk(_of(edges, pairs).select("repo_id", "child", "idx", "parent"), sides))
    left = pairs.join(walked.withColumnRenamed("start", "left"), ["repo_id", "left"], "inner")
    right = walked.select("repo_id", F.col("start").alias("right"), "sha")
    there = commits.select("repo_id", "sha", F.lit(True).alias("_there")).distinct()
    met = left.join(right, ["repo_id", "right", "sha"], "inner").join(there, ["repo_id", "sha"], "left")
    shared = met.groupBy("repo_id", "left", "right").agg(F.min_by("sha", F.when(F.col("_there"), F.col("rank"))).alias("base"))
    nothing = F.lit(None)
    return shared.select("repo_id", "left", "right", "base", F.when(F.col("base").isNull(), "missing commit").alias("reason"), nothing.cast("bigint").alias("visited"))


def unvisited(frontier: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    """Frontier rows that were not visited yet."""
    return frontier.join(visited.select(*keys), keys, "left_anti")


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """(repo_id, sha) reachable from both sides."""
    return left.select("repo_id", "sha").intersect(right.select("repo_id", "sha"))


def check_links(commits: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Malformed parent and target hashes, and parents and targets that do not exist."""
    links = edges.select("repo_id", F.lit("parent").alias("link"), F.col("child").alias("source"), F.col("parent").alias("sha")).unionByName(
        refs.select("repo_id", F.lit("ref").alias("link"), F.col("full").alias("source"), "sha")
    )
    known = commits.select("repo_id", "sha").distinct().withColumn("_there", F.lit(True))
    problem = F.when(~is_hash(F.col("sha")), "malformed").when(F.col("_there").isNull(), "missing")
    return links.join(known, ["repo_id", "sha"], "left").withColumn("problem", problem).filter("problem is not null").drop("_there")
