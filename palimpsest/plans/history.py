"""Walks, refs and revisions over one repository per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import history as H, refs as R
from palimpsest.plans.inputs import HISTORY_SQL, Registry, history
from palimpsest.session import durable

registry = Registry()
_WITH = f"with recursive {HISTORY_SQL}"
_SIDES = """pairs as (select l.repo_id, l.start "left", r.start "right" from lasts l join befores r using (repo_id)),
lwalk as (select p.*, w.sha, w.rank from pairs p join ranked w on w.repo_id=p.repo_id and w.start=p."left"),
rwalk as (select p.*, w.sha from pairs p join ranked w on w.repo_id=p.repo_id and w.start=p."right")"""


def _walked(spark, sf, starts="starts"):
    h = history(spark, sf)
    return h, H.walk(h["edges"], h[starts])


def _pairs(h):
    return h["lasts"].withColumnRenamed("start", "left").join(h["befores"].withColumnRenamed("start", "right"), "repo_id")


_LOG_SQL = f"{_WITH} select w.repo_id, w.start, w.rank, w.sha, w.depth, c.ts::varchar as at, l.ref from ranked w left join commits c using (repo_id, sha) left join labels l on l.repo_id=w.repo_id and l.sha=w.sha"


def _log(spark, sf, **how):
    h = history(spark, sf)
    rows = H.log(h["commits"], h["edges"], h["starts"], h["refs"], **how)
    return rows.select("repo_id", "start", "rank", "sha", "depth", F.col("ts").cast("string").alias("at"), "ref")


@registry.add("h1_log", _LOG_SQL)
def h1(spark, sf):
    return _log(spark, sf)


@registry.add("h1_log_by_sections", _LOG_SQL)
def h1_sections(spark, sf):
    """The same by sections of a few edges, as a repository takes that does not fit into one task."""
    return _log(spark, sf, repo_edges=0, section_edges=8)


@registry.add("h2_ancestors", f"{_WITH} select distinct repo_id, start, sha from paths")
def h2(spark, sf):
    h = history(spark, sf)
    return H.ancestors(h["commits"], h["edges"], h["starts"]).select("repo_id", "start", "sha")


@registry.add(
    "h3_is_ancestor",
    f"""{_WITH}, tested as (select repo_id, start, sha candidate from starts join (select repo_id, sha from commits union all select repo_id, sha from refs where "full"='refs/heads/dangling') using (repo_id))
    select repo_id, start, candidate, exists (select 1 from paths p where p.repo_id=t.repo_id and p.start=t.start and p.sha=t.candidate) as is_ancestor from tested t""",
)
def h3(spark, sf):
    h = history(spark, sf)
    dangling = h["refs"].filter("full = 'refs/heads/dangling'").select("repo_id", "sha")
    candidates = h["commits"].select("repo_id", "sha").unionByName(dangling).withColumnRenamed("sha", "candidate")
    return H.is_ancestor(h["commits"], h["edges"], h["starts"].join(candidates, "repo_id"))


@registry.add(
    "h3_generations",
    f"""{_WITH}, names as (select repo_id, child sha from edges union select repo_id, parent from edges),
    up(repo_id, sha, g) as (select repo_id, sha, 1 from names where (repo_id, sha) not in (select repo_id, child from edges)
      union all select e.repo_id, e.child, u.g+1 from up u join edges e on e.repo_id=u.repo_id and e.parent=u.sha),
    line(repo_id, sha, below) as (select repo_id, sha, sha from names union all select l.repo_id, e.parent, l.below from line l join edges e on e.repo_id=l.repo_id and e.child=l.sha and e.idx=0)
    select repo_id, sha, generation, behind from (select repo_id, sha, max(g)::bigint generation from up group by 1, 2) join (select repo_id, sha, count(*) behind from line group by 1, 2) using (repo_id, sha)""",
)
def h3_generations(spark, sf):
    """Labels of reachability: generations, and how many commits' lines of first parents lead through a commit."""
    labels = H.reach_labels(history(spark, sf)["edges"])
    return labels.select("repo_id", "sha", "generation", (F.col("last") - F.col("first") + 1).alias("behind"))


@registry.add(
    "h4_merge_base",
    f"""{_WITH}, {_SIDES}, shared as (select l.repo_id, l."left", l."right", arg_min(l.sha, l.rank) base from lwalk l join rwalk r using (repo_id, "left", "right", sha) group by 1, 2, 3)
    select repo_id, "left", "right", base, case when base is null then 'no common ancestor' end as reason from pairs left join shared using (repo_id, "left", "right")""",
)
def h4(spark, sf):
    h = history(spark, sf)
    return H.merge_base(h["commits"], h["edges"], _pairs(h)).select("repo_id", "left", "right", "base", "reason")


REVISIONS_SQL = """revs as (select repo_id, unnest(['HEAD', '', 'main', 'dev', ' alt ', 'v1', 'refs/heads/main', 'heads/main', 'tags/v1', 'refs/heads/none', 'no such branch', '0f1e',
    'zzzzzzzz-zz', sha, substr(sha,1,10), substr(sha,1,7), substr(sha,1,6), 'dangling']) revision from s where seq=0),
asked as (select *, trim(revision) r from revs),
named as (select a.*, case
    when r='' then null
    when r='HEAD' then coalesce(h.sha, hr.sha)
    when starts_with(r,'refs/') then full_ref.sha
    when starts_with(r,'heads/') or starts_with(r,'tags/') then short_ref.sha
    else coalesce(branch.sha, tag.sha, c.sha) end named
  from asked a left join heads h on h.repo_id=a.repo_id left join refs hr on hr.repo_id=a.repo_id and hr."full"=h.ref
  left join refs full_ref on full_ref.repo_id=a.repo_id and full_ref."full"=r
  left join refs short_ref on short_ref.repo_id=a.repo_id and short_ref."full"='refs/'||r
  left join refs branch on branch.repo_id=a.repo_id and branch."full"='refs/heads/'||r
  left join refs tag on tag.repo_id=a.repo_id and tag."full"='refs/tags/'||r
  left join commits c on c.repo_id=a.repo_id and c.sha=r),
prefixes as (select n.repo_id, n.revision, count(distinct c.sha) k, min(c.sha) hit from named n join commits c on c.repo_id=n.repo_id and starts_with(c.sha, n.r)
  where length(n.r)>=7 group by 1, 2)"""


def _revisions(h):
    words = ["HEAD", "", "main", "dev", " alt ", "v1", "refs/heads/main", "heads/main", "tags/v1", "refs/heads/none", "no such branch", "0f1e", "zzzzzzzz-zz"]
    sha = F.col("sha")
    forms = [F.lit(w) for w in words] + [sha, F.substring(sha, 1, 10), F.substring(sha, 1, 7), F.substring(sha, 1, 6), F.lit("dangling")]
    return h["numbered"].filter("seq = 0").select("repo_id", F.explode(F.array(*forms)).alias("revision"))


@registry.add(
    "h5_resolve_revisions",
    f"""{_WITH}, {REVISIONS_SQL} select n.repo_id, n.revision, coalesce(named, case when k=1 then hit end) as sha,
      case when r='' then 'empty' when coalesce(named, case when k=1 then hit end) is not null then 'ok' when k>1 then 'ambiguous' else 'unknown' end as status
    from named n left join prefixes using (repo_id, revision)""",
)
def h5(spark, sf):
    h = history(spark, sf)
    return R.resolve_revisions(_revisions(h), h["refs"], h["heads"], h["commits"])


@registry.add(
    "h6_resolve_prefix",
    f"""{_WITH}, short as (select repo_id, substr(sha,1,8) revision from commits union select repo_id, substr(sha,1,6) from commits)
    select s.repo_id, s.revision, case when count(distinct c.sha)=1 then min(c.sha) end as match,
      case count(distinct c.sha) when 0 then 'unknown' when 1 then 'ok' else 'ambiguous' end as status
    from short s left join commits c on c.repo_id=s.repo_id and starts_with(c.sha, s.revision) and length(s.revision)>=7 group by 1, 2""",
)
def h6(spark, sf):
    commits = history(spark, sf)["commits"]
    short = commits.select("repo_id", F.explode(F.array(F.substring("sha", 1, 8), F.substring("sha", 1, 6))).alias("revision"))
    return R.resolve_prefix(short, commits)


@registry.add("h7_list_branches", f"""{_WITH} select repo_id, substr("full", 12) as name, "full", sha, false as malformed from refs where starts_with("full", 'refs/heads/')""")
def h7(spark, sf):
    return R.list_refs(history(spark, sf)["refs"], "heads")


@registry.add("h7_list_tags", f"""{_WITH} select repo_id, substr("full", 11) as name, "full", sha, false as malformed from refs where starts_with("full", 'refs/tags/')""")
def h7_tags(spark, sf):
    return R.list_refs(history(spark, sf)["refs"], "tags")


MOVES_SQL = """moves as (select repo_id, unnest(['refs/heads/main','refs/heads/dev','refs/heads/dev','refs/heads/gone','refs/tags/v1','refs/heads/alt']) source,
    unnest(['refs/heads/trunk','refs/heads/main','refs/tags/dev','refs/heads/new','refs/heads//x','refs/heads/trunk']) target from s where seq=0),
judged as (select m.*, r.sha, case when contains(target,'//') then 'malformed' when not starts_with(target,'refs/heads/') then 'not a branch' when r.sha is null then 'missing'
    when t.sha is not null or source <> (select min(source) from moves x where x.repo_id=m.repo_id and x.target=m.target) then 'taken' end reason
  from moves m left join refs r on r.repo_id=m.repo_id and r."full"=source left join refs t on t.repo_id=m.repo_id and t."full"=target)"""


def _moves(h):
    pairs = [
        ("refs/heads/main", "refs/heads/trunk"), ("refs/heads/dev", "refs/heads/main"), ("refs/heads/dev", "refs/tags/dev"),
        ("refs/heads/gone", "refs/heads/new"), ("refs/tags/v1", "refs/heads//x"), ("refs/heads/alt", "refs/heads/trunk"),
    ]
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pairs])).alias("m")
    return h["numbered"].filter("seq = 0").select("repo_id", both).select("repo_id", "m.*")


@registry.add(
    "h8_rename_refs",
    f"""{_WITH}, {MOVES_SQL}
    select 'ref' as what, repo_id, "full" as name, sha as value from refs r where not exists (select 1 from judged j where j.repo_id=r.repo_id and j.source=r."full" and reason is null)
    union all select 'ref', repo_id, target, sha from judged where reason is null
    union all select 'head', h.repo_id, coalesce(j.target, h.ref), h.sha from heads h left join judged j on j.repo_id=h.repo_id and j.source=h.ref and j.reason is null
    union all select reason, repo_id, source, target from judged where reason is not null""",
)
def h8(spark, sf):
    h = history(spark, sf)
    refs, heads, refused = R.rename_refs(h["refs"], h["heads"], _moves(h))
    return (
        refs.select(F.lit("ref").alias("what"), "repo_id", F.col("full").alias("name"), F.col("sha").alias("value"))
        .unionByName(heads.select(F.lit("head").alias("what"), "repo_id", F.col("ref").alias("name"), F.col("sha").alias("value")))
        .unionByName(refused.select(F.col("reason").alias("what"), "repo_id", F.col("source").alias("name"), F.col("target").alias("value")))
    )


_GONE_SQL = """gone as (select repo_id, unnest(['refs/heads/dev', 'refs/tags/v0', 'refs/heads/../x']) "full" from s where seq=0)"""


@registry.add(
    "h9_delete_refs",
    f"""{_WITH}, {_GONE_SQL} select 'kept' as what, repo_id, "full" from refs where (repo_id, "full") not in (select repo_id, "full" from gone)
    union all select case when contains("full", '..') then 'invalid ref' else 'missing' end, repo_id, "full" from gone where (repo_id, "full") not in (select repo_id, "full" from refs)""",
)
def h9(spark, sf):
    h = history(spark, sf)
    names = F.explode(F.array(F.lit("refs/heads/dev"), F.lit("refs/tags/v0"), F.lit("refs/heads/../x"))).alias("full")
    kept, failed = R.delete_refs(h["refs"], h["numbered"].filter("seq = 0").select("repo_id", names))
    return kept.select(F.lit("kept").alias("what"), "repo_id", "full").unionByName(failed.select(F.col("reason").alias("what"), "repo_id", "full"))


@registry.add(
    "h10_resolve_heads",
    f"""{_WITH} select h.repo_id, h.ref, coalesce(r.sha, h.sha) as sha, case when coalesce(r.sha, h.sha) is null then 'unborn' when h.ref is null then 'detached' else 'symbolic' end as state
    from heads h left join refs r on r.repo_id=h.repo_id and r."full"=h.ref""",
)
def h10(spark, sf):
    h = history(spark, sf)
    return R.resolve_heads(h["heads"], h["refs"])


@registry.add(
    "h10_set_heads",
    f"""{_WITH}, up as (select repo_id, case when seq=0 then 'refs/heads/dev' end ref, sha from s where seq=0 and repo_id%2=0 union all select repo_id, null, sha256('x'||sha) from s where seq=0 and repo_id%4=1
      union all select repo_id, null, sha from s where seq=0 and repo_id%4=3)
    select 'head' as what, h.repo_id, case when repo_id%2=0 then 'refs/heads/dev' when repo_id%4=3 then null else h.ref end as ref, case when repo_id%2=0 then null when repo_id%4=3 then (select sha from s where s.repo_id=h.repo_id and seq=0) else h.sha end as sha from heads h
    union all select 'unknown commit', repo_id, null, sha from up where repo_id%4=1""",
)
def h10_set(spark, sf):
    h = history(spark, sf)
    root = h["numbered"].filter("seq = 0")
    updates = (
        root.filter("repo_id % 2 = 0").select("repo_id", F.lit("refs/heads/dev").alias("ref"), "sha")
        .unionByName(root.filter("repo_id % 4 = 1").select("repo_id", F.lit(None).cast("string").alias("ref"), F.sha2(F.concat(F.lit("x"), "sha"), 256).alias("sha")))
        .unionByName(root.filter("repo_id % 4 = 3").select("repo_id", F.lit(None).cast("string").alias("ref"), "sha"))
    )
    heads, rejected = R.set_heads(h["heads"], updates, h["commits"])
    return heads.select(F.lit("head").alias("what"), "repo_id", "ref", "sha").unionByName(rejected.select(F.col("reason").alias("what"), "repo_id", "ref", "sha"))


@registry.add(
    "h11_check_links",
    f"""{_WITH}, cut as (select repo_id, sha from s where seq<>1), links as (select repo_id, 'parent' link, child source, case when idx=1 then upper(parent) else parent end sha from edges
      union all select repo_id, 'ref', "full", sha from refs)
    select repo_id, link, source, sha, case when not regexp_matches(sha, '^[0-9a-f]{{64}}$') then 'malformed' else 'missing' end as problem from links
    where (repo_id, sha) not in (select repo_id, sha from cut)""",
)
def h11(spark, sf):
    h = history(spark, sf)
    cut = h["numbered"].filter("seq <> 1").select("repo_id", "sha")
    edges = h["edges"].withColumn("parent", F.expr("case when idx = 1 then upper(parent) else parent end"))
    return H.check_links(cut, edges, h["refs"]).select("repo_id", "link", "source", "sha", "problem")


@registry.add("w3_bfs_rank", f"{_WITH} select repo_id, start, sha, rank from ranked")
def w3(spark, sf):
    return H.bfs_rank(durable(_walked(spark, sf)[1])).select("repo_id", "start", "sha", "rank")


@registry.add("o3_log_limit", f"{_WITH} select repo_id, start, sha, rank from ranked where rank <= 4")
def o3(spark, sf):
    h = history(spark, sf)
    return H.log(h["commits"], h["edges"], h["starts"], h["refs"], limit=4).select("repo_id", "start", "sha", "rank")


@registry.add("j8_decorate_with_refs", f"{_WITH} select c.repo_id, c.sha, l.ref from commits c left join labels l on l.repo_id=c.repo_id and l.sha=c.sha")
def j8(spark, sf):
    h = history(spark, sf)
    return H.decorate_with_refs(h["commits"].select("repo_id", "sha"), h["refs"])


@registry.add(
    "u2_unvisited",
    f"{_WITH} select repo_id, sha from (select distinct p.repo_id, p.sha from paths p join lasts l on l.repo_id=p.repo_id and l.start=p.start) except select p.repo_id, p.sha from paths p join befores l on l.repo_id=p.repo_id and l.start=p.start",
)
def u2(spark, sf):
    h, walked = _walked(spark, sf)
    walked = durable(walked)
    ahead = walked.join(h["lasts"], ["repo_id", "start"], "left_semi").select("repo_id", "sha")
    behind = walked.join(h["befores"], ["repo_id", "start"], "left_semi").select("repo_id", "sha")
    return H.unvisited(ahead, behind, ["repo_id", "sha"])


@registry.add(
    "u3_common",
    f"{_WITH} select p.repo_id, p.sha from paths p join lasts l on l.repo_id=p.repo_id and l.start=p.start intersect select p.repo_id, p.sha from paths p join befores l on l.repo_id=p.repo_id and l.start=p.start",
)
def u3(spark, sf):
    h, walked = _walked(spark, sf)
    walked = durable(walked)
    left = walked.join(h["lasts"], ["repo_id", "start"], "left_semi")
    right = walked.join(h["befores"], ["repo_id", "start"], "left_semi")
    return H.common(left, right)


_UPDATES_SQL = """up as (select repo_id, 'refs/heads/main' "full", sha from s where seq=0 union all select repo_id, 'refs/heads/fresh', sha from s where seq=0
  union all select repo_id, 'refs/heads/fresh2', sha256('none|'||repo_id::varchar) from s where seq=0 union all select repo_id, 'heads/bad', sha from s where seq=0
  union all select repo_id, 'refs/tags/short', substr(sha,1,10) from s where seq=0)"""


@registry.add(
    "s5_upsert_refs",
    f"""{_WITH}, {_UPDATES_SQL} select 'ref' as what, repo_id, "full", case when "full"='refs/heads/main' then (select sha from s where s.repo_id=r.repo_id and seq=0) else sha end as sha from refs r
    union all select 'ref', repo_id, "full", sha from up where "full"='refs/heads/fresh'
    union all select case "full" when 'refs/heads/fresh2' then 'unknown commit' when 'heads/bad' then 'invalid ref' else 'invalid hash' end, repo_id, "full", sha from up where "full" not in ('refs/heads/main','refs/heads/fresh')""",
)
def s5(spark, sf):
    h = history(spark, sf)
    root = h["numbered"].filter("seq = 0")
    none = F.sha2(F.concat(F.lit("none|"), F.col("repo_id").cast("string")), 256)
    forms = [
        ("refs/heads/main", F.col("sha")), ("refs/heads/fresh", F.col("sha")), ("refs/heads/fresh2", none), ("heads/bad", F.col("sha")), ("refs/tags/short", F.substring("sha", 1, 10)),
    ]
    updates = root.select("repo_id", F.explode(F.array(*[F.struct(F.lit(f).alias("full"), v.alias("sha")) for f, v in forms])).alias("u")).select("repo_id", "u.*")
    refs, rejected = R.upsert_refs(h["refs"], updates, h["commits"])
    return refs.select(F.lit("ref").alias("what"), "repo_id", "full", "sha").unionByName(rejected.select(F.col("reason").alias("what"), "repo_id", "full", "sha"))
