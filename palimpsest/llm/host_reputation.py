"""URL filter: rules first, then empirical-Bayes reputation of hosts.

Outcomes of labelled pages are counted per host, registered domain and suffix. Each level has a beta
prior whose mean is the posterior mean of the level above and whose strength is estimated from how
much the groups of that level scatter (moments of the beta-binomial). One group, or groups of one
page each, say nothing about scatter; the spread is then MOST_SPREAD. A host passes if the lower
bound of its posterior does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BOUND = 0.5  # least posterior bound of a host that passes
SIGMAS = 1.0  # how far below the posterior mean the bound lies
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5  # limits of the estimated correlation inside groups

Rule = tuple[str, str, str]


def parts(pages: DataFrame, url: str) -> DataFrame:
    """`pages` with host, path, domain (last two labels of the host) and suffix (the last). Without `://` all are empty."""
    split = pages.withColumn("_url", F.coalesce(F.col(url).cast("string"), F.lit("")))
    host = F.regexp_extract(F.expr("substring(_url, instr(_url, '://') + 3)"), "^[^/?#]*", 0)
    split = split.withColumn("host", F.when(F.instr("_url", "://") > 0, F.translate(host, UPPER, LOWER)).otherwise(""))
    rest = F.expr("substring(_url, instr(_url, '://') + 3 + char_length(host))")
    path = F.when(F.instr("_url", "://") > 0, F.regexp_extract(rest, "^[^?#]*", 0)).otherwise("")
    return split.withColumns({"path": path, "domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)}).drop("_url")


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule (verdict, host, path) that fits host and path, as a struct; `rules` is a short list given in code."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = out.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def _spread(groups: DataFrame) -> tuple[float, float]:
    """Mean and strength of the beta prior of groups (n, k)."""
    sums = groups.agg(F.sum("n").alias("N"), F.sum("k").alias("K"), F.count("*").alias("G"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("S"), F.sum(F.col("n") * F.col("n")).alias("Q"))
    p = F.col("K") / F.col("N")
    told = (F.col("G") > 1) & (F.col("N") > F.col("G"))  # exactly where rho's denominator is not 0
    scatter = F.col("S") - F.col("N") * p * p
    rho = (scatter - p * (1 - p) * (F.col("G") - 1)) / (p * (1 - p) * (F.col("N") - F.col("Q") / F.col("N") - (F.col("G") - 1)))
    rho = F.least(F.lit(MOST_SPREAD), F.greatest(F.lit(LEAST_SPREAD), F.coalesce(F.when(told & (p * (1 - p) > 0), rho), F.lit(MOST_SPREAD))))
    found = sums.select(F.coalesce(p, F.lit(0.5)).alias("p"), (1 / rho - 1).alias("strength")).first()
    return found["p"], found["strength"]


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per host of `hosts` (host, domain, suffix; distinct): labelled (pages), good (of them), bound.

    `outcomes` has a row (host, domain, suffix, good 0/1) per labelled page. A host, domain or suffix
    without labelled pages inherits the level above; without any outcomes every prior has mean 1/2.
    """
    counted = outcomes.where(F.col("good").isNotNull()).groupBy("suffix", "domain", "host").agg(F.count("*").alias("n"), F.sum("good").cast("bigint").alias("k"))
    by_domain = counted.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    levels = hosts.withColumn("prior", F.lit(_spread(by_suffix)[0]))
    for keys, groups in ((["suffix"], by_suffix), (["suffix", "domain"], by_domain), (["suffix", "domain", "host"], counted)):
        strength = _spread(groups)[1]
        levels = levels.join(groups.select(*keys, F.col("n").alias("_n"), F.col("k").alias("_k")), keys, "left").na.fill(0, ["_n", "_k"])
        a, b = strength * F.col("prior") + F.col("_k"), strength * (1 - F.col("prior")) + F.col("_n") - F.col("_k")
        levels = levels.withColumns({"_a": a, "_b": b, "labelled": F.col("_n"), "good": F.col("_k")}).withColumn("prior", F.col("_a") / (F.col("_a") + F.col("_b"))).drop("_n", "_k")
    mean = F.col("prior")
    return levels.select("host", "domain", "suffix", "labelled", "good", (mean - SIGMAS * F.sqrt(mean * (1 - mean) / (F.col("_a") + F.col("_b") + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], url: str = "url", outcome_url: str = "url", good: str = "good") -> DataFrame:
    """`pages` with host, path, rule (null if none fits), labelled, good, verdict (allow or block).

    `outcomes` has a url and good (0/1) per labelled page; null outcomes are passed over. A null url, or one without `://`, has an
    empty host and path and is judged like any other host. Hosts are counted first, so a host with a
    third of all pages costs one row per task; the judged hosts are joined back to the pages.
    Columns of `pages` named like the new ones are replaced; all others come back as they are.
    """
    new = ("host", "path", "rule", "labelled", "good", "verdict")
    kept = [c for c in pages.columns if c not in new]
    split = parts(pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{url}`").alias("url")), "url")
    known = parts(outcomes.select(F.col(outcome_url).alias("_u"), F.col(good).cast("int").alias("good")), "_u").select("host", "domain", "suffix", "good")
    judged = reputations(split.select("host", "domain", "suffix").distinct(), known)
    joined = split.join(judged.select("host", "labelled", "good", "bound"), "host").withColumn("_rule", rule_of(rules))
    own = F.when(F.col("bound") >= BOUND, "allow").otherwise("block")
    return joined.select("row.*", "host", "path", F.col("_rule.rule").alias("rule"), "labelled", "good", F.coalesce(F.col("_rule.verdict"), own).alias("verdict"))
