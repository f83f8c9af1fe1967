"""Branches, tags, HEAD and revision lookup for many repositories.

Tables: refs(repo_id, full, sha), heads(repo_id, ref, sha) with either `ref` or `sha` set. A refs
table has one writer at a time: updates read and rewrite it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.names import is_hash, is_ref
from palimpsest.operators.aggregates import unique_match

SHORT_HASH = 7


def list_refs(refs: DataFrame, kind: str) -> DataFrame:
    """Branches (`heads`) or tags (`tags`) by name: repo_id, name, full, sha, malformed."""
    prefix = f"refs/{kind}/"
    mine = refs.filter(F.col("full").startswith(prefix))
    listed = mine.select("repo_id", F.expr(f"substring(full, {len(prefix) + 1})").alias("name"), "full", "sha", (~is_hash(F.col("sha"))).alias("malformed"))
    return listed.orderBy("repo_id", "name")


def upsert_refs(refs: DataFrame, updates: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point refs at commits: (new refs table, rejected updates with reason).

    The name must be valid and the commit must exist. Of several updates of one ref none is done: they
    come back with the reason `repeated`.
    """
    known = commits.select("repo_id", "sha").distinct().withColumn("_there", F.lit(True))
    reason = (
        F.when(~is_ref(F.col("full")), "invalid ref")
        .when(~is_hash(F.col("sha")), "invalid hash")
        .when(F.col("_there").isNull(), "unknown commit")
        .when(F.col("_times") > 1, "repeated")
    )
    times = updates.groupBy("repo_id", "full").agg(F.count("*").alias("_times"))
    judged = updates.join(known, ["repo_id", "sha"], "left").join(times, ["repo_id", "full"], "left").withColumn("reason", reason).drop("_there", "_times")
    accepted = judged.filter("reason is null").select("repo_id", "full", F.col("sha").alias("_new"))
    merged = refs.join(accepted, ["repo_id", "full"], "full").select("repo_id", "full", F.coalesce("_new", "sha").alias("sha"))
    return merged, judged.filter("reason is not null").select("repo_id", "full", "sha", "reason")


def delete_refs(refs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove refs: (remaining refs, names with reason `invalid ref` or `missing`)."""
    valid = names.filter(is_ref(F.col("full")))
    remaining = refs.join(valid.select("repo_id", "full"), ["repo_id", "full"], "left_anti")
    there = refs.select("repo_id", "full", F.lit(True).alias("_there"))
    reason = F.when(~is_ref(F.col("full")), "invalid ref").when(F.col("_there").isNull(), "missing")
    failed = names.join(there, ["repo_id", "full"], "left").withColumn("reason", reason).filter("reason is not null")
    return remaining, failed.select("repo_id", "full", "reason")


def rename_refs(refs: DataFrame, heads: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move branches to free names, HEAD follows: (refs, heads, refused moves with reason).

    Moves (repo_id, source, target) are independent of each other. A target named by several moves
    goes to the smallest source; a source named by several moves goes to the smallest target, and the
    others find it `missing`.
    """
    taken = refs.select("repo_id", F.col("full").alias("target"), F.lit(True).alias("_taken"))
    have = refs.select("repo_id", F.col("full").alias("source"), F.col("sha").alias("_sha"))
    chosen = moves.groupBy("repo_id", "source").agg(F.min("target").alias("_chosen"))
    first = moves.join(chosen, ["repo_id", "source"], "left")
    rivals = first.filter("target = _chosen").groupBy("repo_id", "target").agg(F.min("source").alias("_winner"))
    reason = (
        F.when(~is_ref(F.col("source")) | ~is_ref(F.col("target")), "malformed")
        .when(~F.col("target").startswith("refs/heads/"), "not a branch")
        .when(F.col("_sha").isNull() | (F.col("target") != F.col("_chosen")), "missing")
        .when(F.col("_taken") | (F.col("source") != F.col("_winner")), "taken")
    )
    judged = (
        first.distinct().join(have, ["repo_id", "source"], "left")
        .join(taken, ["repo_id", "target"], "left")
        .join(rivals, ["repo_id", "target"], "left")
        .withColumn("reason", reason)
    )
    done = judged.filter("reason is null")
    kept = refs.join(done.select("repo_id", F.col("source").alias("full")), ["repo_id", "full"], "left_anti")
    moved = done.select("repo_id", F.col("target").alias("full"), F.col("_sha").alias("sha"))
    followed = heads.join(done.select("repo_id", F.col("source").alias("ref"), "target"), ["repo_id", "ref"], "left")
    new_heads = followed.select("repo_id", F.coalesce("target", "ref").alias("ref"), "sha")
    return kept.unionByName(moved), new_heads, judged.filter("reason is not null").select("repo_id", "source", "target", "reason")


def resolve_heads(heads: DataFrame, refs: DataFrame) -> DataFrame:
    """HEAD of each repository: repo_id, ref (null when detached), sha (null when unborn), state."""
    pointed = refs.select("repo_id", F.col("full").alias("ref"), F.col("sha").alias("_sha"))
    state = (
        F.when(F.col("ref").isNotNull() & ~is_ref(F.col("ref")), "invalid ref")
        .when(F.coalesce("_sha", "sha").isNull(), "unborn")
        .when(~is_hash(F.coalesce("_sha", "sha")), "invalid hash")
        .when(F.col("ref").isNull(), "detached")
        .otherwise("symbolic")
    )
    joined = heads.join(pointed, ["repo_id", "ref"], "left")
    return joined.select("repo_id", "ref", F.coalesce("_sha", "sha").alias("sha"), state.alias("state"))


def set_heads(heads: DataFrame, updates: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point HEADs at a ref name or an existing commit: (new heads, rejected with reason).

    Of several updates of one repository none is done: they come back with the reason `repeated`.
    """
    known = commits.select("repo_id", "sha").distinct().withColumn("_there", F.lit(True))
    reason = (
        F.when(F.col("ref").isNotNull(), F.when(~is_ref(F.col("ref")), "invalid ref"))
        .when(~is_hash(F.col("sha")), "invalid hash")
        .when(F.col("_there").isNull(), "unknown commit")
    )
    reason = F.coalesce(reason, F.when(F.col("_times") > 1, "repeated"))
    times = updates.groupBy("repo_id").agg(F.count("*").alias("_times"))
    judged = updates.join(known, ["repo_id", "sha"], "left").join(times, "repo_id", "left").withColumn("reason", reason).drop("_there", "_times")
    accepted = judged.filter("reason is null").select(
        "repo_id", F.col("ref").alias("_ref"), F.when(F.col("ref").isNull(), F.col("sha")).alias("_sha"), F.lit(True).alias("_set")
    )
    pick = lambda new, old: F.when(F.col("_set"), F.col(new)).otherwise(F.col(old))
    merged = heads.join(accepted, "repo_id", "full").select("repo_id", pick("_ref", "ref").alias("ref"), pick("_sha", "sha").alias("sha"))
    return merged, judged.filter("reason is not null").select("repo_id", "ref", "sha", "reason")


def resolve_prefix(revisions: DataFrame, commits: DataFrame) -> DataFrame:
    """Short hashes of at least 7 characters: repo_id, revision, match, status ok/ambiguous/unknown.

    The join key is the 7-character prefix, which hashes spread evenly.
    """
    head = lambda c: F.substring(c, 1, SHORT_HASH).alias("_head")
    asked = revisions.select("repo_id", "revision").distinct().withColumn("_head", head("revision"))
    long_enough = asked.filter(F.length("revision") >= SHORT_HASH)
    known = commits.select("repo_id", "sha", head("sha"))
    hits = long_enough.join(known, ["repo_id", "_head"], "inner").filter(F.expr("startswith(sha, revision)"))
    matched = unique_match(hits.select("repo_id", "revision", "sha"), ["repo_id", "revision"], "sha")
    answer = asked.join(matched, ["repo_id", "revision"], "left")
    return answer.select("repo_id", "revision", "match", F.coalesce("status", F.lit("unknown")).alias("status"))


def resolve_revisions(revisions: DataFrame, refs: DataFrame, heads: DataFrame, commits: DataFrame) -> DataFrame:
    """Revisions to commits: repo_id, revision, sha, status ok/empty/unknown/ambiguous.

    Tried in order: HEAD, a full ref, `heads/…` or `tags/…`, a branch, a tag, a full hash, a short
    hash. A form that is explicit (HEAD, refs/…, heads/…, tags/…) does not fall through.
    """
    text = F.trim(F.coalesce("revision", F.lit("")))
    asked = revisions.select("repo_id", "revision", text.alias("_rev")).distinct()
    explicit = (F.col("_rev") == "HEAD") | F.col("_rev").rlike("^(refs|heads|tags)/")
    names = (
        F.when(F.col("_rev") == "HEAD", F.array(F.lit("HEAD")))
        .when(F.col("_rev").startswith("refs/"), F.array("_rev"))
        .when(explicit, F.array(F.concat(F.lit("refs/"), "_rev")))
        .otherwise(F.array(F.concat(F.lit("refs/heads/"), "_rev"), F.concat(F.lit("refs/tags/"), "_rev"), "_rev"))
    )
    tried = asked.filter("_rev <> ''").select("repo_id", "revision", F.posexplode(names).alias("_order", "_name"))
    targets = (
        refs.filter(is_ref(F.col("full")) & is_hash(F.col("sha"))).select("repo_id", F.col("full").alias("_name"), "sha")
        .unionByName(resolve_heads(heads, refs).filter("state in ('symbolic', 'detached')").select("repo_id", F.lit("HEAD").alias("_name"), "sha"))
        .unionByName(commits.select("repo_id", F.col("sha").alias("_name"), "sha"))
    )
    named = tried.join(targets, ["repo_id", "_name"], "inner").groupBy("repo_id", "revision").agg(F.min_by("sha", "_order").alias("_named"))
    short = resolve_prefix(
        asked.filter(~explicit & (F.length("_rev") >= SHORT_HASH)).select("repo_id", F.col("_rev").alias("revision")), commits
    ).select("repo_id", F.col("revision").alias("_rev"), F.col("match").alias("_match"), F.col("status").alias("_status"))
    answer = asked.join(named, ["repo_id", "revision"], "left").join(short, ["repo_id", "_rev"], "left")
    status = (
        F.when(F.col("_rev") == "", "empty")
        .when(F.coalesce("_named", "_match").isNotNull(), "ok")
        .when(F.col("_status") == "ambiguous", "ambiguous")
        .otherwise("unknown")
    )
    return answer.select("repo_id", "revision", F.coalesce("_named", "_match").alias("sha"), status.alias("status"))
