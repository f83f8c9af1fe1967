"""N-gram Jaccard join by prefix trees, and the groups of near duplicates it links.

A document's set holds its distinct word shingles in one global order: rarest first, by counts over
all documents in a table of fixed size, then by hash. Two sets that are similar enough share k of their
first n - ceil(t n) + k shingles, so only these travel, and a set that shares fewer of them with any
others than its share of k links with nothing and is dropped. Classes of equal sets that meet at a
shingle form cells around the smallest class; a task stores the whole sets of a cell in a trie and
looks each up in it: sets with a common beginning share the overlap counted so far, and a subtree is
left as soon as the lengths that remain cannot reach the threshold, or when everything below is
already linked. Cells of any size are cut into blocks; pairs of blocks that are not linked yet are
joined afterwards, so no link is lost. Links are a spanning forest, not all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from palimpsest.llm.blocks import VISIBLE, Words, mix, slices
from palimpsest.session import durable

SHINGLE = 5
SIMILARITY = 80  # per cent
COUNTERS = 1 << 24  # counters of the order; a fixed size, so their levels (a byte each) may be broadcast
EXTRA = 20  # k is one in so many of a set's shingles, at least 1
COUNTER_BLOCK = 1 << 16  # counters that travel as one compressed row
HOT_LEVEL = 16  # shingles whose counter passed 2**16,
HOT_MARGIN = 6  # and 2**6 times the mean counter, are dealt out by class as well
SALTS = 64
FILTER_BITS = 1 << 23
BLOCK_SETS = 1000
BLOCK_SHINGLES = 1_000_000


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; fewer words than `size` make one shingle, none make none."""
    words = Words(texts, VISIBLE)
    hashes, _ = words.windows(size)
    for begin, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if end - begin >= size:
            yield np.unique(hashes[begin : end - size + 1])
        elif end > begin:
            whole = np.array([end - begin], dtype=np.uint64)
            for h in words.hashes[begin:end]:
                whole = mix(whole * np.uint64(3) + h)
            yield whole
        else:
            yield np.zeros(0, dtype=np.uint64)


def _key(hashes: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        both = np.array([mix(hashes).sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(mix(hashes + np.uint64(len(hashes))))], dtype=np.uint64)
    return int(mix(both).view(np.int64)[0])


def _described(documents: DataFrame, size: int) -> DataFrame:
    """One row per document (doc_id, text_hash, n, key) and, per task, the shingle counters (block, counts: compressed)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "n", "key", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint16)
        ids = None
        for batch in batches:
            ids = batch.column("doc_id")
            n, keys = [], []
            for _, texts in slices(batch.column("text")):
                for hashes in shingle_sets(texts, size):
                    n.append(len(hashes))
                    keys.append(_key(hashes) if len(hashes) else None)
                    at = (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)
                    counts[at] = np.minimum(counts[at], 65_534) + 1
            nothing = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), *nothing], names)
        packer = zstandard.ZstdCompressor(level=1)
        for begin in range(0, COUNTERS if ids is not None else 0, COUNTER_BLOCK):
            part = counts[begin : begin + COUNTER_BLOCK]
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), none, none, none, pa.array([begin // COUNTER_BLOCK], pa.int32()), pa.array([packer.compress(part.tobytes())])], names)

    plain = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return plain.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n bigint, key bigint, block int, counts binary")


def _levels(described: DataFrame):
    """The counters' powers of two, broadcast: COUNTERS bytes, whatever the corpus. And the level of their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, None

        def done() -> pa.RecordBatch:
            level = np.log2(np.maximum(sums, 1)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()]), pa.array([int(sums.sum())])], ["block", "levels", "total"])

        for batch in batches:
            for own, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if own != block:
                    if block is not None:
                        yield done()
                    block, sums = own, np.zeros(COUNTER_BLOCK, dtype=np.int64)
                sums += np.frombuffer(zstandard.decompress(data), dtype=np.uint16)
        if block is not None:
            yield done()

    levels, total = np.zeros(COUNTERS, dtype=np.uint8), 0
    parts = described.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    for row in parts.mapInArrow(run, "block int, levels binary, total bigint").toLocalIterator():
        levels[row["block"] * COUNTER_BLOCK :][:COUNTER_BLOCK] = np.frombuffer(row["levels"], dtype=np.uint8)
        total += row["total"]
    return described.sparkSession.sparkContext.broadcast(levels), int(np.log2(max(1, total / COUNTERS)))


def _order(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Positions of the hashes in the global order, rarest first."""
    return np.lexsort((hashes, levels[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]))


def _prefixes(documents: DataFrame, levels, size: int, similarity: int, hot_level: int) -> DataFrame:
    """The necessary shingles of each class: token, salt (-1: none), key, n. A task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                tokens, keys, sizes = [], [], []
                for hashes in shingle_sets(texts, size):
                    key = _key(hashes) if len(hashes) else None
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    n = len(hashes)
                    tokens.append(hashes[_order(hashes, level)[: n + similarity * -n // 100 + max(1, n // EXTRA)]])
                    keys.append(key)
                    sizes.append(n)
                if keys:
                    token, repeat = np.concatenate(tokens), [len(x) for x in tokens]
                    key, n = np.repeat(np.array(keys, dtype=np.int64), repeat), np.repeat(np.array(sizes, dtype=np.int32), repeat)
                    hot = level[(token & np.uint64(COUNTERS - 1)).astype(np.int64)] >= hot_level
                    salt = np.where(hot, key % SALTS, -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(key), pa.array(n)], ["token", "salt", "key", "n"])

    return documents.select("text").mapInArrow(run, "token bigint, salt int, key bigint, n int")


def _texts_of(documents: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """`keys` (one row per class) with one text of each. A bit table of fixed size keeps most others from being shuffled."""
    bits = np.zeros(FILTER_BITS, dtype=bool)
    places = keys.select(F.expr(f"cast(key & {FILTER_BITS - 1} as int)").alias("b")).distinct()
    for row in places.groupBy((F.col("b") / 4096).cast("int")).agg(F.collect_list("b").alias("b")).toLocalIterator():
        bits[row["b"]] = True
    table = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(table.value).view(bool), set()
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                rows, found = [], []
                for row, hashes in enumerate(shingle_sets(texts, size)):
                    key = _key(hashes) if len(hashes) else None
                    if key is not None and key not in seen and wanted[key & (FILTER_BITS - 1)]:
                        seen.add(key)
                        rows.append(row)
                        found.append(key)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), texts.take(pa.array(rows)).cast(pa.string())], ["key", "text"])

    some = documents.select("text").mapInArrow(run, "key bigint, text string")
    return some.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key")


class Trie:
    """Ordered sets of a block, joined one by one. Places in the order are dense numbers within the block."""

    class Node:
        __slots__ = ("run", "below", "leaf", "least", "most", "group")

        def __init__(self, run: np.ndarray, leaf: int, n: int) -> None:
            self.run, self.below, self.leaf, self.least, self.most, self.group = run, {}, leaf, n, n, leaf

    def __init__(self, sets: list[np.ndarray], similarity: int) -> None:
        self.sets, self.similarity = sets, similarity
        self.root = self.Node(np.zeros(0, dtype=np.int64), -1, 0)
        self.root.least, self.root.group = 1 << 60, -1
        self.mask = np.zeros(1 + max((int(x[-1]) for x in sets if len(x)), default=0), dtype=bool)
        self.parent = list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def links(self, groups: list) -> Iterator[tuple[int, int]]:
        """Pairs (i, j) that link sets not linked before; sets with the same entry in `groups` count as linked."""
        first: dict = {}
        for i, group in enumerate(groups):
            self.parent[i] = first.setdefault(group, i)
        for i in range(len(self.sets)):
            for j in self._similar(i):
                self.parent[self.find(j)] = self.find(i)
                yield i, j
            self._insert(i)

    def _similar(self, i: int) -> Iterator[int]:
        own, mask, t = self.sets[i], self.mask, self.similarity
        n = len(own)
        mask[own] = True
        stack = [(node, 0, 0) for node in self.root.below.values()]
        while stack:
            node, overlap, seen = stack.pop()
            if node.most * 100 < t * n or n * 100 < t * node.least:
                continue
            if node.group >= 0 and self.find(node.group) == self.find(i):
                continue
            overlap += int(np.count_nonzero(mask[node.run]))
            seen += len(node.run)
            remaining = min(node.most - seen, n - int(np.searchsorted(own, node.run[-1], "right")))
            if (100 + t) * (overlap + remaining) < t * (n + node.least):
                continue
            j = node.leaf
            if j >= 0 and (100 + t) * overlap >= t * (n + seen) and self.find(j) != self.find(i):
                mask[own] = False
                yield j
                mask[own] = True
            stack.extend((child, overlap, seen) for child in node.below.values())
        mask[own] = False

    def _insert(self, i: int) -> None:
        own, node, at, n = self.sets[i], self.root, 0, len(self.sets[i])
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.group >= 0 and self.find(node.group) != self.find(i):
                node.group = -1
            if at == n:  # an equal set is stored already
                if node.leaf < 0:
                    node.leaf = i
                return
            child = node.below.get(int(own[at]))
            if child is None:
                node.below[int(own[at])] = self.Node(own[at:], i, n)
                return
            length = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:length] != own[at : at + length])
            same = int(differ[0]) if len(differ) else length
            if same < len(child.run):
                upper = self.Node(child.run[:same], -1, n)
                upper.least, upper.most, upper.group = child.least, child.most, child.group
                child.run = child.run[same:]
                upper.below[int(child.run[0])] = child
                node.below[int(own[at])] = child = upper
            node, at = child, at + same


def _join_blocks(members: DataFrame, levels, size: int, similarity: int) -> DataFrame:
    """Links (a, b) between the sets of each block of `members` (block, key, known, text); equal numbers in `known` count as linked."""

    def linked(rows: list[tuple[int, int | None]], texts: list[pa.Array]) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=lambda i: rows[i][0])
        sets: list[np.ndarray] = []
        for _, some in slices(pa.concat_arrays(texts)):
            sets.extend(shingle_sets(some, size))
        bounds = np.cumsum([0, *(len(sets[i]) for i in order)])
        tokens, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        ranks = np.empty(len(tokens), dtype=np.int64)
        ranks[_order(tokens, levels.value)[::-1]] = np.arange(len(tokens))  # frequent first, so beginnings are shared
        places = ranks[inverse]
        ordered = [np.sort(places[b:e]) for b, e in zip(bounds[:-1], bounds[1:])]
        known = [(i, None) if rows[o][1] is None else (None, rows[o][1]) for i, o in enumerate(order)]
        pairs = [(rows[order[i]][0], rows[order[j]][0]) for i, j in Trie(ordered, similarity).links(known)]
        return pa.RecordBatch.from_pydict({"a": [x for x, _ in pairs], "b": [y for _, y in pairs]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, texts = None, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for begin, end in zip(borders[:-1], borders[1:]):
                if rows and int(blocks[begin]) != block:
                    yield linked(rows, texts)
                    rows, texts = [], []
                block = int(blocks[begin]) if end > begin else block
                part = batch.slice(begin, end - begin)
                rows.extend(zip(part.column("key").to_pylist(), part.column("known").to_pylist()))
                texts.append(part.column("text"))
        if rows:
            yield linked(rows, texts)

    return members.select("block", "key", "known", "text").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def _links(plain: DataFrame, shared: DataFrame, levels, size: int, similarity: int, block_sets: int, block_shingles: int) -> DataFrame:
    """A spanning forest of all links between classes that share a necessary shingle: a, b."""

    def blocks() -> F.Column:
        return F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / block_shingles)).cast("int")

    def pick(n: F.Column) -> F.Column:
        return F.pmod(F.xxhash64("key", F.lit(1)), n).cast("int")

    members = shared.where("key <> lo").select(F.col("lo").alias("cell"), "key", "n").distinct()
    cut = durable(members.join(members.groupBy("cell").agg(blocks().alias("blocks")), "cell").withColumn("block", F.xxhash64("cell", pick(F.col("blocks")))))
    rows = cut.select("block", "key").union(cut.select("block", "cell").distinct())
    hot = cut.where("blocks > 1").selectExpr("xxhash64(cell, 1) as g", "key", "n").union(shared.where("salt >= 0").selectExpr("xxhash64(token, 2) as g", "key", "n")).distinct()
    # A class brings the numbers of its blocks along (no more than it has cells, and blocks in the cell it is the centre of),
    # so texts go to their blocks straight from here, without another shuffle by key.
    wanted = rows.union(hot.selectExpr("cast(null as bigint) as block", "key")).groupBy("key").agg(F.collect_list("block").alias("blocks"))
    placed = durable(_texts_of(plain, durable(wanted), size))
    texts, none = placed.select("key", "text"), F.lit(None).cast("bigint").alias("known")
    links = durable(_join_blocks(placed.select(F.explode("blocks").alias("block"), "key", none, "text"), levels, size, similarity))
    labels = components(links)
    marked = hot.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    apart = marked.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("g")
    open_ = durable(marked.join(apart, "g", "left_semi"))
    if open_.isEmpty():
        return links
    per = open_.groupBy("g", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    main = per.groupBy("g").agg(F.max_by("label", F.struct("sets", "label")).alias("main"))
    sides = open_.join(main, "g").withColumn("other", F.col("label") != F.col("main"))
    part = lambda which: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(which.cast("int")) / block_sets, F.sum(F.when(which, F.col("n")).otherwise(0)) / block_shingles))).cast("int")
    widths = sides.groupBy("g").agg(part(~F.col("other")).alias("wide"), part(F.col("other")).alias("rest"))
    sides = sides.join(widths, "g")
    rest = sides.where("other").withColumn("i", pick(F.col("rest")))
    among = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).withColumn("block", F.xxhash64("g", F.lit(0), F.least("i", "j"), F.greatest("i", "j")))
    across = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumn("block", F.xxhash64("g", F.lit(1), "i", "j"))
    whole = sides.where("not other").withColumn("j", pick(F.col("wide"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).withColumn("block", F.xxhash64("g", F.lit(1), "i", "j"))
    again = among.select("block", "key", "label").union(across.select("block", "key", "label")).union(whole.select("block", "key", "label"))
    more = _join_blocks(again.withColumnRenamed("label", "known").join(texts, "key"), levels, size, similarity)
    return links.union(durable(more))


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of the graph of `edges` (a, b); large-star and small-star rounds until nothing changes."""
    edges = durable(edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = None
    while True:
        both = edges.union(edges.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v")
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v"))
        edges = durable(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first()
        if state == before:
            return edges.selectExpr("u as node", "v as label").union(edges.selectExpr("v as node", "v as label").distinct())
        before = state


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, hot_level: int = HOT_LEVEL) -> DataFrame:
    """Per row of `documents`: doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable by links), label.

    Texts that are null or hold no word have an empty set and link with nothing, not even with each
    other: their component_id is their own doc_id. Rows that repeat a document each give a row. Null
    ids are passed over where another id is in the group. `label` names the group whatever its ids
    are, and is null for an empty set. Other columns are not looked at.
    """
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = durable(_described(plain, size))
    levels, mean = _levels(described)
    near = Window.partitionBy("token", "salt")
    sent = _prefixes(plain, levels, size, similarity, max(hot_level, mean + HOT_MARGIN))
    placed = sent.withColumns({"lo": F.min("key").over(near), "hi": F.max("key").over(near)})
    shared = durable(placed.where("lo < hi or salt >= 0").drop("lo", "hi").distinct())
    # A partner has at least `similarity` per cent of the set's size, so k at least that share of the set's own.
    least = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.floor(F.max("n") / EXTRA)) * similarity / 100))
    enough = shared.groupBy("key").agg(F.count("*").alias("met"), least.alias("least")).where("met >= least").select("key")
    placed = shared.join(enough, "key", "left_semi").withColumns({"lo": F.min("key").over(near), "hi": F.max("key").over(near)})
    shared = durable(placed.where("lo < hi or salt >= 0").drop("hi"))
    links = _links(plain, shared, levels, size, similarity, block_sets, block_shingles)
    labels = components(links)
    sets = described.where("block is null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "key")
    named = sets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")
