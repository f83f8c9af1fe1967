"""Walks over commit graphs that are too large for one task, section by section.

Edges are cut into sections by height, the length of the line of first parents below a commit; heights come from
pointer doubling and are only a hint of what lies together, so cycles do no harm. **Distances**: each round a task
carries new distances through a whole section and offers what leaves it to other sections, so a walk takes about as
many rounds as it crosses sections, not one per level or merge. **Order**: with distances known, names of one distance
are ordered by (place of the child, parent position). Distances are cut into blocks; a task works through a whole
block and hands only the places of its last distance to the next one. What is kept of a name has a fixed size.
Rounds are written to the checkpoint folder. They know names by numbers in their order, and names are put back at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.operators.graph_tasks import ordered, relax
from palimpsest.session import durable

SECTION_EDGES = 200_000  # of a section or block, about
BROADCAST_ROWS = 10_000
MAX_PIECES = 12
STRIPS = 4_000  # distances of a walk are counted in at most so many strips

Rounds = Callable[[str], None]


def _few(df: DataFrame) -> DataFrame:
    """A materialised table, marked for a broadcast if it has few rows (counted), else to be merged: numbers compress so well that Spark may take it for small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def _per_group(rows: DataFrame, keys: Sequence[str], work: Callable[[tuple, list[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """`work` of the key and the rows (other columns) of each group. Groups come in batches: there may be very many small ones."""
    arrow, width = to_arrow_schema(schema), len(keys)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        own, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:width] != own:
                    if held:
                        yield own, held
                    own, held = row[:width], []
                held.append(row[width:])
        if held:
            yield own, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for key, own in groups(batches) for row in work(key, own))
        while chunk := list(islice(found, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), arrow.types)], schema=arrow)

    shaped = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return shaped.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _numbered(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges and starts with numbers for names, then the name of each number, and that of each start.

    Numbers follow the order of names in a repository. An edge without a child or parent leads nowhere and is left out.
    """
    own = edges.where("child is not null and parent is not null").select("repo_id", F.monotonically_increasing_id().alias("edge"), F.col("idx").cast("int").alias("idx"), "child", "parent")
    ends = durable(own, "zstd").select("repo_id", "edge", "idx", F.posexplode(F.array("child", "parent")).alias("end", "sha"))
    asked = starts.select("repo_id", F.lit(None).cast("bigint").alias("edge"), F.lit(None).cast("int").alias("idx"), F.lit(2).alias("end"), F.col("start").alias("sha"))
    name = ["repo_id", "sha"]
    rows = ends.unionByName(asked).repartitionByRange(*name).sortWithinPartitions(*name).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("number", F.min("_at").over(W.partitionBy(*name))).withColumn("first", F.col("_at") == F.col("number"))
    rows = durable(rows.select("repo_id", "number", "first", "edge", "idx", "end", F.when(F.col("first") | (F.col("end") == 2), F.col("sha")).alias("sha")), "zstd")
    children = rows.where("end = 0").select("repo_id", "edge", "idx", F.col("number").alias("child"))
    parents = rows.where("end = 1").select("edge", F.col("number").alias("parent"))
    links = durable(children.join(parents, "edge").select("repo_id", "child", "idx", "parent"))
    begun = rows.where("end = 2").select("repo_id", "number", "sha").distinct()
    return links, begun.select("repo_id", F.col("number").alias("start")), rows.where("first").select("number", "sha"), begun.select("number", "sha")


def _named(rows: DataFrame, names: DataFrame, starts: DataFrame) -> DataFrame:
    """`rows` with names again instead of the numbers in start and sha."""
    found = rows.withColumnsRenamed({"start": "_start", "sha": "number"}).join(names, "number").drop("number")
    found = found.withColumnRenamed("_start", "number").join(starts.withColumnRenamed("sha", "start"), "number")
    return found.select(*rows.columns)


def heights(edges: DataFrame, seen: Rounds) -> DataFrame:
    """repo_id, sha, height: steps along first parents, by pointer doubling; on a cycle some number."""
    first = edges.groupBy("repo_id", F.col("child").alias("sha")).agg(F.min_by("parent", F.struct("idx", "parent")).alias("to"))
    pointers = durable(first.withColumn("height", F.lit(1).cast("bigint")))
    rounds, done = pointers.count().bit_length(), None
    for _ in range(rounds):
        ahead = pointers.select("repo_id", F.col("sha").alias("to"), F.col("to").alias("_to"), F.col("height").alias("_more"))
        moved = pointers.where(F.col("to").isNotNull()).join(ahead, ["repo_id", "to"], "left")
        moved = moved.select("repo_id", "sha", F.col("_to").alias("to"), (F.col("height") + F.coalesce("_more", F.lit(0))).alias("height"))
        pointers = durable(moved.unionByName(pointers.where(F.col("to").isNull())))
        seen("height")
        if pointers.where(F.col("to").isNotNull()).isEmpty():
            break
    return pointers.select("repo_id", "sha", "height")


def cut(edges: DataFrame, size: int, seen: Rounds) -> tuple[DataFrame, DataFrame]:
    """(edges with the section of child and parent, sections of names): about `size` edges each."""
    high = heights(edges, seen)
    sizes = edges.groupBy("repo_id").agg(F.count("*").alias("n")).join(high.groupBy("repo_id").agg(F.max("height").alias("top")), "repo_id")
    steps = _few(durable(sizes.select("repo_id", F.greatest(F.lit(1), F.ceil(F.col("top") * size / F.col("n"))).alias("step"))))
    places = durable(high.join(steps, "repo_id").select("repo_id", "sha", F.floor(F.col("height") / F.col("step")).alias("section")))
    # What has no parents lies at the bottom.
    zero = F.lit(0).cast("bigint")
    placed = edges.join(places.withColumnRenamed("sha", "child"), ["repo_id", "child"], "left").withColumn("section", F.coalesce("section", zero))
    above = places.select("repo_id", F.col("sha").alias("parent"), F.col("section").alias("to_section"))
    return durable(placed.join(above, ["repo_id", "parent"], "left").withColumn("to_section", F.coalesce("to_section", zero))), places


def distances(edges: DataFrame, starts: DataFrame, within: int | None, size: int, seen: Rounds) -> DataFrame:
    """repo_id, start, sha, depth of all names each start reaches."""
    links, begun, names, start_names = _numbered(edges, starts)
    return _named(_distances(links, begun, within, size, seen), names, start_names)


def _distances(edges: DataFrame, starts: DataFrame, within: int | None, size: int, seen: Rounds) -> DataFrame:
    """The same where names are numbers."""
    placed, places = cut(edges, size, seen)
    zero = F.lit(0).cast("bigint")
    begun = starts.join(places.withColumnRenamed("sha", "start"), ["repo_id", "start"], "left")
    fresh = durable(begun.select("repo_id", "start", F.coalesce("section", zero).alias("section"), F.col("start").alias("sha"), zero.alias("depth")))
    schema = T.StructType([*fresh.schema.fields, T.StructField("inside", T.BooleanType())])
    none = F.lit(None).cast("bigint")

    def carry(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        repo, start, own = key
        parents: dict[int, list[tuple[int, int]]] = {}
        held: dict[int, int] = {}
        new: dict[int, int] = {}
        for kind, sha, parent, number in rows:
            if kind == 0:
                parents.setdefault(sha, []).append((parent, number))
            else:
                known = held if kind == 1 else new
                known[sha] = min(number, known.get(sha, number))
        found, offers = relax(parents, held, new, own, within)
        yield from ((repo, start, own, n, d, True) for n, d in found.items())
        yield from ((repo, start, s, n, d, False) for (s, n), d in offers.items())

    key, best = ["repo_id", "start", "section", "sha"], F.min("depth").alias("depth")
    labels, pieces = fresh.limit(0), 0
    while not fresh.isEmpty():
        active = _few(durable(fresh.select("repo_id", "start", "section").distinct()))
        links = placed.join(active, ["repo_id", "section"]).select("repo_id", "start", "section", F.lit(0).alias("kind"), F.col("child").alias("sha"), "parent", F.col("to_section").alias("number"))
        held = labels.join(active, ["repo_id", "start", "section"], "left_semi")
        known = [x.select("repo_id", "start", "section", F.lit(kind).alias("kind"), "sha", none.alias("parent"), F.col("depth").alias("number")) for kind, x in ((1, held), (2, fresh))]
        rows = links.unionByName(known[0]).unionByName(known[1])
        out = durable(_per_group(rows, ["repo_id", "start", "section"], carry, schema))
        seen("distance")
        labels, pieces = labels.unionByName(out.where("inside").drop("inside")), pieces + 1
        if pieces == MAX_PIECES:
            labels, pieces = durable(labels.groupBy(*key).agg(best)), 0
        offers = _few(durable(out.where("not inside").groupBy(*key).agg(best)))
        old = labels.join(offers.select(*key), key, "left_semi").groupBy(*key).agg(F.min("depth").alias("_old"))
        fresh = durable(offers.join(old, key, "left").where("_old is null or depth < _old").drop("_old"))
    return durable(labels.groupBy("repo_id", "start", "sha").agg(best))


def _blocks(links: DataFrame, size: int) -> DataFrame:
    """`links` with `block`: distances in order, about `size` links each. Counted in strips, so no list is as long as a history."""
    walk = ["repo_id", "start"]
    deepest = _few(durable(links.groupBy(*walk).agg(F.max("depth").alias("_most"))))
    strip = F.expr(f"depth div (1 + _most div {STRIPS})")
    counts = links.join(deepest, walk).groupBy(*walk, strip.alias("strip")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*walk).orderBy("strip")) - F.col("n")
    own = W.partitionBy(*walk).orderBy("share")  # numbers without gaps: a walk has its blocks in a row
    strips = counts.select(*walk, "strip", F.floor(before / size).alias("share")).withColumn("block", F.dense_rank().over(own) - 1).drop("share")
    strips = _few(durable(strips))
    return links.join(deepest, walk).withColumn("strip", strip).join(strips, [*walk, "strip"]).drop("strip", "_most")


def ranks(edges: DataFrame, labels: DataFrame, size: int, seen: Rounds) -> DataFrame:
    """repo_id, start, sha, depth, rank of names (as numbers) whose distances are known: their 1-based place in the walk."""
    walk = ["repo_id", "start"]
    children = labels.select(*walk, F.col("sha").alias("child"), "depth")
    parents = labels.select(*walk, F.col("sha").alias("parent"), (F.col("depth") - 1).alias("depth"))
    tight = edges.select("repo_id", "child", "idx", "parent").join(children, ["repo_id", "child"]).join(parents, [*walk, "parent", "depth"])
    links = durable(_blocks(durable(tight.select(*walk, "depth", "child", "idx", "parent")), size))
    blocks = sorted(r["block"] for r in links.select("block").distinct().collect())
    schema = T.StructType([*labels.select(*walk, "sha", "depth").schema.fields, T.StructField("place", T.LongType()), T.StructField("last", T.BooleanType())])

    def place(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        listed, entry = [], {}
        for kind, depth, child, idx, parent in rows:
            if kind == 0:
                listed.append((depth, child, idx, parent))
            else:
                entry[child] = idx
        found = ordered(listed, entry)
        last = found[-1][0] if found else 0
        yield from ((*key, n, d + 1, i, d == last) for i, (d, n) in enumerate(found, 1))

    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = labels.where("depth = 0").select(*walk, "sha", "depth", F.lit(1).cast("bigint").alias("place"), F.lit(True).alias("last"))
    done, border = [roots.withColumn("block", F.lit(-1).cast("bigint"))], roots
    for block in blocks:
        own = links.where(F.col("block") == block)
        entry = border.select(*walk, F.lit(1).alias("kind"), F.col("depth"), F.col("sha").alias("child"), F.col("place").cast("int").alias("idx"), none.alias("parent"))
        asked = _few(own.select(*walk).distinct())
        rows = own.select(*walk, F.lit(0).alias("kind"), "depth", "child", "idx", "parent").unionByName(entry.join(asked, walk, "left_semi"))
        out = durable(_per_group(rows, walk, place, schema))
        seen("order")
        done.append(out.withColumn("block", F.lit(block).cast("bigint")))
        border = out.where("last")
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    counts = placed.groupBy(*walk, "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*walk).orderBy("block")) - F.col("n")  # one row per block
    offsets = counts.select(*walk, "block", before.alias("_before"))
    return placed.join(offsets, [*walk, "block"]).select(*walk, "sha", "depth", (F.col("place") + F.coalesce("_before", zero)).alias("rank"))


def walk(edges: DataFrame, starts: DataFrame, within: int | None = None, size: int = SECTION_EDGES, seen: Rounds = lambda kind: None) -> DataFrame:
    """repo_id, start, sha, depth, rank of first-in-first-out walks; `seen` is told of each round."""
    links, begun, names, start_names = _numbered(edges, starts)
    labels = _distances(links, begun, within, size, seen)
    return _named(ranks(links, labels, size, seen), names, start_names)
