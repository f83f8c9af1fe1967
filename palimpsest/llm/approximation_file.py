"""Exact top-k inner products by vector-approximation files.

Equal vectors are one entry with its k smallest ids. Entries are dealt into blocks of bounded size; a block cuts every
dimension into cells of equal depth and keeps one byte per component, with the least and largest value of each cell.
Blocks of queries meet blocks of approximations: the cells give a lower and an upper bound of each inner product, and
only entries whose upper bound reaches the k-th largest lower bound remain. Of these, exact vectors are read in order
of their bounds until the k-th result is certain: first the k likeliest of a query, then those whose bound reaches
the k-th exact score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from palimpsest.session import durable

CELLS = 256  # per dimension, so a component is one byte
BLOCK = 1 << 16  # entries of a block, about
QUERIES = 1 << 14  # queries of a group, about
TILE = 1 << 21  # bounds computed at once
FEW = 10_000  # lengths of vectors, as rows of a table that may be broadcast
_EXACT = 1 << 53


def scaled(vectors: DataFrame, vec_id: str, embedding: str, factor: float) -> DataFrame:
    """vec_id, dims, wide, data: floor(factor * x) of each component as packed numbers.

    Whole vectors are left out where they are null or hold a null component, or one that is not finite (also after
    scaling). `wide` marks components so large that their inner products may not be exact in doubles.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims, wide, data = [], [], [], []
            for row, value in enumerate(batch.column("x")):
                if not value.is_valid or value.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    numbers = np.floor(factor * value.values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0  # no -0.0
                if not np.isfinite(numbers).all():
                    continue
                rows.append(row)
                dims.append(len(numbers))
                largest = np.abs(numbers).max(initial=0)
                wide.append(bool(largest >= (_EXACT / max(1, len(numbers))) ** 0.5))
                data.append(numbers.astype("<f8" if largest >= 1 << 24 else "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_()), pa.array(data, pa.binary())], ["vec_id", "dims", "wide", "data"])

    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x"))
    return plain.mapInArrow(run, f"vec_id {kind}, dims int, wide boolean, data binary")


def unpacked(data: list[bytes], dims: int) -> np.ndarray:
    """Rows of numbers from packed vectors of one length."""
    out = np.empty((len(data), dims), dtype=np.float64)
    for i, x in enumerate(data):
        out[i] = np.frombuffer(x, dtype="<f8" if len(x) == 8 * dims else "<f4")
    return out


class Approximations:
    """Cells of a block's vectors: one byte per component, and the least and largest value of each cell that is used."""

    def __init__(self, codes: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.codes, self.least, self.most = codes, least, most

    @classmethod
    def of(cls, vectors: np.ndarray) -> Approximations:
        n, dims = vectors.shape
        codes = np.zeros((n, dims), dtype=np.uint8)
        least, most = np.full((dims, CELLS), np.inf), np.full((dims, CELLS), -np.inf)
        for d in range(dims):
            values = vectors[:, d]
            marks = np.unique(np.sort(values)[np.linspace(0, n - 1, CELLS + 1).astype(np.int64)[1:-1]])
            codes[:, d] = np.searchsorted(marks, values, "right")
            np.minimum.at(least[d], codes[:, d], values)
            np.maximum.at(most[d], codes[:, d], values)
        return cls(codes, least, most)

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible inner products; `low` and `high` are the cells' values as given by `decoded`."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T

    def decoded(self) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(self.codes.shape[1])
        return self.least[place, self.codes], self.most[place, self.codes]


def candidates(queries: np.ndarray, found: Approximations, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per query: (place, its k largest lower bounds, places of entries that may be among the first k, their upper bounds).

    Entries stand in the order of their ids, so of entries whose score is known and equal to the k-th bound the first k do.
    """
    low, high = found.decoded()
    n = len(low)
    for first in range(0, len(queries), max(1, TILE // max(1, n))):
        some = queries[first : first + max(1, TILE // max(1, n))]
        least, most = found.bounds(some, low, high)
        best = -np.partition(-least, k - 1, axis=1)[:, :k] if n > k else least
        limit = best.min(axis=1, keepdims=True) if n > k else np.full((len(some), 1), -np.inf)
        for i, there in enumerate(most >= limit):
            places = np.flatnonzero(there)
            tied = (most[i, places] == limit[i, 0]) & (least[i, places] == limit[i, 0])
            places = places[~tied | (np.cumsum(tied) <= k)]
            yield first + i, best[i], places, most[i, places]


def exact(a: np.ndarray, b: np.ndarray, wide: bool) -> list[int]:
    """Inner products of two lists of rows; whole numbers of any size. Scores outside 64 bits are held at their ends."""
    if not wide:
        return np.einsum("ij,ij->i", a, b).astype(np.int64).tolist()
    sums = (sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist()))
    return [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in sums]


def _cell(*parts) -> F.Column:
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts])


def _numbers(count: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))


def _small(df: DataFrame) -> DataFrame:
    """`df`, for a broadcast if it has few rows (counted)."""
    df = durable(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _blocks(dealt: DataFrame) -> DataFrame:
    """One row per block of `dealt` (block, dims, wide, entry, first, data): its entries in the order of their first ids, and the approximations."""
    kinds = {"block": pa.int64(), "dims": pa.int32(), "wide": pa.bool_(), "entries": pa.binary(), "codes": pa.binary(), "least": pa.binary(), "most": pa.binary()}

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("first", "ascending"), ("entry", "ascending")])
        dims, wide = group["dims"][0].as_py(), group["wide"][0].as_py()
        found = Approximations.of(np.zeros((len(group), 0)) if wide else unpacked(group["data"].to_pylist(), dims))
        row = [group["block"][0].as_py(), dims, wide, np.asarray(group["entry"], dtype="<i8").tobytes(), found.codes.tobytes(), found.least.tobytes(), found.most.tobytes()]
        return pa.table({name: pa.array([value], kinds[name]) for name, value in zip(kinds, row)})

    rows = dealt.select("block", "dims", "wide", "entry", "first", "data")
    return rows.groupBy("block").applyInArrow(build, "block bigint, dims int, wide boolean, entries binary, codes binary, least binary, most binary")


def _scan(asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Bounds of the queries of each cell against its block: query, its k largest lower bounds, and the entries that remain with their upper bounds."""
    schema = pa.schema([("query", pa.int64()), ("lows", pa.list_(pa.float64())), ("entries", pa.list_(pa.int64())), ("highs", pa.list_(pa.float64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        block, out = {c: right[c][0].as_py() for c in right.column_names}, []
        dims, names, entries = block["dims"], left["entry"].to_pylist(), np.frombuffer(block["entries"], dtype="<i8")
        wide = np.asarray(left["wide"].to_pylist(), dtype=bool) | block["wide"]
        narrow = np.flatnonzero(~wide)
        if len(narrow):
            found = Approximations(*[np.frombuffer(block[c], dtype=kind).reshape(shape) for c, kind, shape in (("codes", np.uint8, (len(entries), dims)), ("least", np.float64, (dims, CELLS)), ("most", np.float64, (dims, CELLS)))])
            queries = unpacked([left["data"][i].as_py() for i in narrow.tolist()], dims)
            out.extend((names[narrow[i]], lows, entries[places], highs) for i, lows, places, highs in candidates(queries, found, k))
        out.extend((names[i], [], entries, np.full(len(entries), np.inf)) for i in np.flatnonzero(wide).tolist())  # no bound is safe there
        return pa.table([pa.array([x[j] for x in out], t) for j, t in enumerate(schema.types)], schema=schema)

    return asked.groupBy("cell").cogroup(cells.groupBy("cell")).applyInArrow(run, "query bigint, lows array<double>, entries array<bigint>, highs array<double>")


def _scored(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """`reads` (query, entry) with the exact score: both vectors are joined by entry."""
    vectors = entries.select("entry", "dims", "wide", "data")
    query = vectors.select(F.col("entry").alias("query"), F.col("data").alias("q"), F.col("wide").alias("w"))
    both = reads.join(vectors, "entry").join(query, "query").select("query", "entry", "dims", (F.col("wide") | F.col("w")).alias("wide"), "data", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, wide = batch.column("dims").to_numpy(), np.asarray(batch.column("wide").to_pylist(), dtype=bool)
            a, b, scores = batch.column("data").to_pylist(), batch.column("q").to_pylist(), np.zeros(len(batch), dtype=np.int64)
            for d, w in sorted(set(zip(dims.tolist(), wide.tolist()))):
                rows = np.flatnonzero((dims == d) & (wide == w))
                scores[rows] = exact(unpacked([a[i] for i in rows], d), unpacked([b[i] for i in rows], d), w)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("entry"), pa.array(scores)], ["query", "entry", "score"])

    return both.mapInArrow(run, "query bigint, entry bigint, score bigint")


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """query, `name`: the k-th largest `value` of each query that has so many. Only k rows of a query leave a task."""
    ranked = rows.select("query", value).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col(value).desc())))
    return ranked.where(F.col("place") <= k).groupBy("query").agg(F.min(value).alias(name), F.count("*").alias("had")).where(F.col("had") == k).drop("had")


def top_k(vectors: DataFrame, is_query: str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", factor: float = 1.0, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query with all other rows.

    Components are floor(factor * x). Queries are the rows where the SQL condition `is_query` on vec_id holds; a query's
    own row is no candidate, other rows with its id are. Ties go to the smaller vec_id, null ids last. Vectors of another
    length than the query's are no candidates; those that are null, or hold null or non-finite components, take no part.
    With fewer than k candidates all are returned, without any no row. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    wanted = k + 1  # the query's own row may be among them
    rows = durable(scaled(vectors, vec_id, embedding, factor).withColumn("entry", F.xxhash64("data", "dims")))
    ids = Window.partitionBy("entry", "data").orderBy(F.col("vec_id").asc_nulls_last())
    firsts = rows.withColumn("place", F.row_number().over(ids)).where(F.col("place") <= wanted)
    entries = firsts.groupBy("entry", "data", "dims", "wide").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    entries = durable(entries.withColumn("first", F.col("ids")[0]))
    asked = rows.where(is_query)
    size = min(block, max(1, -(-entries.count() // (2 * spark.sparkContext.defaultParallelism))))  # two blocks a core at least
    share = _small(entries.groupBy("dims", "wide").agg(F.ceil(F.count("*") / size).alias("blocks")))
    dealt = entries.join(share, ["dims", "wide"]).withColumn("block", _cell("dims", "wide", F.pmod(_cell("entry", F.lit(1)), F.col("blocks"))))
    queried = durable(asked.select("entry").distinct().join(entries, "entry").select("entry", "dims", "wide", "data"))
    groups = _small(queried.groupBy("dims").agg(F.ceil(F.count("*") / queries).alias("groups")))
    number = F.pmod(_cell("entry", F.lit(2)), F.col("groups"))
    placed = queried.join(groups, "dims").withColumn("group", number).join(share.withColumnRenamed("wide", "side"), "dims")
    placed = placed.select("entry", "wide", "data", "group", "dims", "side", _numbers("blocks").alias("i")).withColumn("block", _cell("dims", "side", "i"))
    cells = durable(_blocks(dealt)).join(groups, "dims").withColumn("group", _numbers("groups"))
    scanned = durable(_scan(placed.select(_cell("block", "group").alias("cell"), "entry", "wide", "data"), cells.drop("groups").withColumn("cell", _cell("block", "group")).drop("group"), wanted))
    limit = _kth(scanned.select("query", F.explode("lows").alias("low")), "low", wanted, "limit")
    opened = scanned.select("query", F.explode(F.arrays_zip("entries", "highs")).alias("x")).select("query", F.col("x.entries").alias("entry"), F.col("x.highs").alias("high"))
    left = opened.join(limit, "query", "left").where("limit is null or high >= limit").select("query", "entry", "high")
    order = Window.partitionBy("query").orderBy(F.col("high").desc(), "entry")
    left = durable(left.withColumn("place", F.row_number().over(order)))
    early = durable(_scored(left.where(F.col("place") <= wanted).select("query", "entry"), entries))
    certain = _kth(early, "score", wanted, "found")
    late = left.where(F.col("place") > wanted).join(certain, "query", "left").where("found is null or high >= found")
    scores = early.unionByName(_scored(late.select("query", "entry"), entries))
    ranked = scores.join(entries.select("entry", "ids", "first"), "entry").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last())))
    each = ranked.where(F.col("place") <= wanted).select("query", "entry", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "entry")
    first = durable(each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= wanted))
    lists = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "entry"))).alias("found"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(lists, "query")
    mine = F.array_position(F.transform("found", lambda x: F.coalesce((x["vec_id"] == F.col("query_id")) & (x["entry"] == F.col("query")), F.lit(False))), True).cast("int")
    others = F.filter("found", lambda x, i: i + 1 != F.col("mine"))
    listed = own.withColumn("mine", mine).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
