"""Learned decision lists: sequential covering over labelled statistics, as ordered Spark conditions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.expressions import WHITE, WORD, chars_in, has_word, let
from palimpsest.session import durable

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
CUTS = 31  # thresholds tried per feature
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_PRECISION, MIN_COVER = 0.9, 5  # of a rule, on rows it was not grown on
FEATURES = ("n_words", "mean_word", "symbol_rate", "mark_rate", "upper_rate", "dup_line_rate", "repeat_rate", "digit_rate")


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """How many words stand in windows of `size` words that occur at least twice among `words`, the first included."""

    def covered(windows: Column) -> Column:
        def places(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
            return F.filter(F.transform(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.when(same(i, i + 1) | same(i, i - 1), F.get(pairs, i)["i"])), F.isnotnull)

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spans = lambda at: F.aggregate(
            F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(size)))), F.lit(0), lambda a, n: a + n
        )
        return let(F.sort_array(let(pairs, places)), spans)

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) < size + 1, 0).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Per row: doc_id, the counts of its whole text, and FEATURES (whole numbers, rates per 1000); with `carry` also
    the row itself, as the struct `row`.

    A null text counts as an empty one; all counts and rates are then 0. Equal rows give equal rows.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = [F.struct(*documents.columns).alias("row")] if carry else []
    plain = documents.select(F.col(doc_id).alias("doc_id"), whole.alias("t"), *own)
    own = ["row"] if carry else []
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("t", "\n"), has_word)
    counted = plain.select(
        "doc_id",
        *own,
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).cast("bigint").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("x"),
        F.char_length(F.translate("t", WHITE, "")).cast("bigint").alias("word_chars"),
        chars_in(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        chars_in(F.col("t"), "!?|~^_=").cast("bigint").alias("n_marks"),
        chars_in(F.col("t"), UPPER).cast("bigint").alias("n_upper"),
        chars_in(F.col("t"), "0123456789").cast("bigint").alias("n_digits"),
    ).select("doc_id", *own, "w.*", "x.*", "word_chars", "n_symbols", "n_marks", "n_upper", "n_digits")
    rate = lambda a, b, by=1000: F.coalesce(F.expr(f"({by} * {a}) div nullif({b}, 0)"), F.lit(0)).cast("bigint")
    return counted.withColumns({
        "mean_word": rate("word_chars", "n_words", 10),
        "symbol_rate": rate("n_symbols", "word_chars"),
        "mark_rate": rate("n_marks", "word_chars"),
        "upper_rate": rate("n_upper", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "digit_rate": rate("n_digits", "word_chars"),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.at_least else F.col(self.feature) < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition.column()
    return out


def _tightest(conditions: list[Condition]) -> list[Condition]:
    """Without conditions that another one on the same side of the same feature implies."""
    least: dict[tuple[str, bool], Condition] = {}
    for c in conditions:
        own = least.get((c.feature, c.at_least))
        if own is None or (c.value > own.value) == c.at_least:
            least[c.feature, c.at_least] = c
    return [c for c in conditions if least[c.feature, c.at_least] is c]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information a condition adds for the rows it keeps."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, features: tuple[str, ...] = FEATURES, bad: str = "bad", fold: str = "fold") -> list[list[Condition]]:
    """Rules (conjunctions) that single out rows with `bad` = true, in the order found.

    Rows with fold 0 prune and judge, the others grow. All labelled rows count; what reaches the
    driver are counts per feature and threshold. Thresholds are exact quantiles, reckoned from counts per
    value (whole numbers, so there are far fewer values than rows): how rows lie in partitions changes nothing.
    Of equal gains the first feature, the smallest threshold and >= go first. Null labels or features are
    passed over. Without rows of both kinds there are no rules.
    """
    rows = labelled.select(*features, F.col(bad).cast("int").alias("bad"), (F.col(fold) == 0).alias("judge")).na.drop()
    probabilities = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found = rows.agg(*[F.percentile(f, probabilities).alias(f) for f in features]).first()
    cuts = {f: sorted({math.ceil(x) for x in found[f] or []}) for f in features}
    bins = F.array(*[sum((F.when(F.col(f) >= c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in features])
    rows = durable(rows.withColumn("bins", bins))
    rules: list[list[Condition]] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            growing = rows.where(left & ~F.col("judge") & _all(rule)).select("bad", F.posexplode("bins").alias("f", "bin"))
            table = growing.groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            best, p0, n0 = (0.0, None), sum(r["p"] for r in table if r["f"] == 0), sum(r["n"] for r in table if r["f"] == 0)
            if p0 < MIN_COVER or not n0:
                break
            for at, feature in enumerate(features):
                for k, cut in enumerate(cuts[feature], 1):
                    for at_least in (True, False):
                        side = [r for r in table if r["f"] == at and (r["bin"] >= k) == at_least]
                        p, n = sum(r["p"] for r in side), sum(r["n"] for r in side)
                        gain = _gain(p, n, p0, n0)
                        if gain > best[0] + 1e-9:
                            best = gain, Condition(feature, at_least, cut)
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        sums = [F.sum(F.when(_all(rule[:k]) & (F.col("bad") == b), 1).otherwise(0)).alias(f"c{k}_{b}") for k in range(1, len(rule) + 1) for b in (0, 1)]
        judged = rows.where(left & F.col("judge")).agg(*sums).first()
        worth = {k: (judged[f"c{k}_1"] or 0, judged[f"c{k}_0"] or 0) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), worth[k][0], -k))
        p, n = worth[k]
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(_tightest(rule[:k]))
        left = left & ~_all(rules[-1])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True for rows that no rule rejects: an ordered conditional expression."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", quality: str = "quality", carry: bool = False) -> DataFrame:
    """`statistics` of every row, with base_failed and kept (not base_failed and no learned rule rejects it).

    `labels` marks documents by `quality` 1 or 0; rows whose id is null or not among the documents
    teach nothing, and repeated labels count as often as they stand there.
    """
    stats = durable(statistics(documents, doc_id, text, carry))
    marked = labels.where(F.col(quality).isNotNull()).select(F.col(label_id).alias("doc_id"), (F.col(quality) == 0).alias("bad"))
    labelled = stats.drop("row").join(marked, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    rules = learn(labelled)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
