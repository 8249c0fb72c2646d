"""Exact top-k search by inner product with a KD-tree in each shard.

Components become whole numbers, ``floor(scale * x)``.  Median splits of a
bounded sample (:data:`SAMPLE_BYTES`) cut space into regions, and every vector
goes to its region, so that near ones meet; a region with many vectors is dealt
over shards of about :data:`PER_SHARD`.  Each shard's tree is built by median
splits of its widest dimension, with tight bounding boxes.  The largest inner
product that a query can have inside a box bounds a node, and nodes are visited
best first until the bound falls below the kth score.

1. A query is first searched where it lies.  The kth score found there is
   propagated with it.
2. The bounds of all shards' outer boxes tell in which other shards a query can
   still find something; it goes to no other.
3. A shard's tree is read once for every :data:`PER_TREE` blocks that come to it,
   never where none comes, and the blocks stream past it.  At most k rows of a
   query and shard come back, and Spark ranks them.

Vectors with a component from 2^62 on do not fit such trees.  They are compared
as they are, in whole numbers of any size: all queries in blocks with these
vectors, and their own queries in blocks with all vectors.

Contract: vectors that are null, or hold null or a component that is not
finite, take no part, and neither do rows with a null id.  Missing trailing
components count as zero.  Rows with the query's own id are not candidates.
Rows that repeat a query's id with another vector are a query of their own.
Ties go to the smaller id.  Components and products of any size are computed as
they are; only a returned score that is not below 2^63 - 1 and above -2^63 is an
error.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import frames

PER_SHARD = 16_384
#: Blocks of queries for which a shard's tree is read once, and boxes that a task compares with a block.
PER_TREE, PER_GROUP = 64, 1024
#: Shards whose blocks meet a group of boxes under one key, and vectors of a block of large components.
PER_KEY, PER_BLOCK = 256, 256
#: Bounds of what the regions are fitted on and of their number.
SAMPLE, SAMPLE_BYTES, REGIONS = 32_768, 16 << 20, 4096
TASK_BYTES = 32 << 20
LEAF = 128
_EXACT = 1 << 53
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_LARGE = float(1 << 62)


@dataclass
class Tree:
    """Vectors in the order of the leaves; node ``i`` holds ``first[i]:last[i]``, and ``left[i]`` is -1 at a leaf."""

    ids: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree by median splits of the widest dimension."""
    order = np.arange(len(ids))
    nodes: list[list] = []
    todo = [(0, len(ids), -1, 2)]
    while todo:
        a, b, parent, side = todo.pop()
        mine = vectors[order[a:b]]
        low, high = mine.min(axis=0), mine.max(axis=0)
        at = len(nodes)
        nodes.append([a, b, -1, -1, low, high])
        if parent >= 0:
            nodes[parent][side] = at
        width = high - low
        if b - a > leaf and width.max() > 0:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, int(np.argmax(width))], half)]
            todo += [(a, a + half, at, 2), (a + half, b, at, 3)]
    first, last, left, right, low, high = zip(*nodes, strict=True)
    return Tree(ids[order], vectors[order], *(np.array(x, np.int64) for x in (first, last, left, right)), np.array(low), np.array(high))


@dataclass
class Regions:
    """Splits of space; below ``left`` or ``right`` a negative number -1 - i is region i.  Region i has the shards ``first[i]`` to ``first[i + 1] - 1``."""

    dim: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        node = np.zeros(len(vectors), np.int64) if len(self.dim) else np.full(len(vectors), -1)
        while len(at := np.flatnonzero(node >= 0)):
            here = node[at]
            node[at] = np.where(vectors[at, self.dim[here]] < self.value[here], self.left[here], self.right[here])
        return -1 - node

    def shards(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The shard of each vector: within a region, any of its shards by the id."""
        region = self.of(vectors)
        several = (self.first[1:] - self.first[:-1])[region].astype(np.uint64)
        return self.first[region] + (A.mix(ids.astype(np.uint64)) % several).astype(np.int64)


def regions(sample: np.ndarray, n: int) -> Regions:
    """``n`` regions by splits of the sample's widest dimension at its median, or the like for an odd number."""
    nodes: list[list[int]] = []
    found = 0

    def cut(some: np.ndarray, n: int) -> int:
        nonlocal found
        width = some.max(axis=0) - some.min(axis=0) if len(some) > 1 else np.zeros(1)
        if n == 1 or not width.max():
            found += 1
            return -found
        dim, half = int(np.argmax(width)), n // 2
        values = np.sort(some[:, dim])
        value = int(values[len(values) * half // n])
        value = value if value > values[0] else int(values[np.searchsorted(values, values[0], side="right")])
        at = len(nodes)
        nodes.append([dim, value, 0, 0])
        low = some[:, dim] < value
        nodes[at][2], nodes[at][3] = cut(some[low], half), cut(some[~low], n - half)
        return at

    cut(sample, n)
    return Regions(*(np.array([x[i] for x in nodes], np.int64) for i in range(4)), np.arange(found + 1))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.int64) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), kind)
    out[np.repeat(np.arange(len(n)), n), A.concat_ranges(np.zeros(len(n), np.int64), n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which the inner products are exact."""
    most = _largest(a) * _largest(b) * max(1, a.shape[1])
    return np.float64 if most < _EXACT else np.int64 if most < 1 << 63 else object


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray, kind: type) -> np.ndarray:
    """The largest product that each query can have inside each box."""
    q = queries.astype(kind)
    return np.maximum(q, 0) @ high.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T


def _longs(scores: np.ndarray) -> np.ndarray:
    """Scores beyond 64 bits become the highest or lowest number, which is an error only if it is returned."""
    return scores.astype(np.int64) if scores.dtype != object else np.array([min(max(s, LOWEST), HIGHEST) for s in scores.tolist()], np.int64)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of its best at least ``kth``, in order; at most k."""
    kind = _kind(tree.vectors, queries)
    vectors, q = tree.vectors.astype(kind), queries.astype(kind)
    bounds = _bounds(queries, tree.low, tree.high, kind)
    left, right, first, last = (x.tolist() for x in (tree.left, tree.right, tree.first, tree.last))
    out = []
    for me, vector, bound, least in zip(query_ids.tolist(), q, bounds, kth.tolist(), strict=True):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64 if kind is not object else object)
        least = -math.inf if least == LOWEST else least
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = first[node], last[node]
            found = (vectors[a:b] @ vector).astype(scores.dtype)
            good = np.flatnonzero((found >= least) & (tree.ids[a:b] != me))
            if len(good):
                ids, scores = np.concatenate([ids, tree.ids[a:b][good]]), np.concatenate([scores, found[good]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
        out.append((ids, _longs(scores)))
    return out


def valid(vector: Column) -> Column:
    """Whether a vector takes part: every component is there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def small(vector: Column, scale: int) -> Column:
    """Whether all whole numbers of a valid vector fit a tree."""
    return F.forall(vector, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < _LARGE)


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component of a small vector."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _whole(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < _EXACT else int(x) * scale


def _blocks(width: int):
    """Vectors of any size as blobs: ids, and components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PER_BLOCK):
                part = batch.slice(at, PER_BLOCK)
                blob = A.pack(part.column(0).to_numpy(), _matrix(part.column(1), width, np.float64))
                yield pa.RecordBatch.from_arrays([A.blobs([blob])], ["_blob"])

    return run


def _comparer(width: int, k: int, scale: int):
    """The best of each block of candidates for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (asked, q), (ids, v) = (A.unpack(row[c]) for c in ("_queries", "_blob"))
                q, v = (np.array([[_whole(x, scale) for x in y] for y in m.reshape(-1, width).tolist()], object).reshape(-1, width) for m in (q, v))
                scores = q @ v.T
                for i, me in enumerate(asked.tolist()):
                    order = sorted((j for j, id_ in enumerate(ids.tolist()) if id_ != me), key=lambda j, mine=scores[i]: (-mine[j], ids[j]))[:k]  # noqa: B023
                    yield _rows(asked[i : i + 1], q[i : i + 1], np.array([len(order)]), ids[order], _longs(scores[i][order]))

    return run


def _block(width: int):
    """One of the blocks that queries are dealt to."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"_n": table["_n"].slice(0, 1), "_queries": A.blobs([A.pack(table["_id"].to_numpy(), _matrix(table["_x"], width, np.float64))])})

    return run


def _compared(queries: DataFrame, candidates: DataFrame, width: int, k: int, scale: int) -> DataFrame:
    """What queries find among candidates (_id, _x), a block with a block: one of the two has large components."""
    n = frames.parts(queries.count(), PER_BLOCK)
    blocks = queries.withColumn("_n", frames.dealt(F.struct("_id", "_x"), n)).groupBy("_n").applyInArrow(_block(width), "_n long, _queries binary")
    blobs = candidates.mapInArrow(_blocks(width), "_blob binary").withColumn("_key", frames.dealt(F.col("_blob"), PER_KEY))
    met = blobs.withColumn("_n", F.explode(_upto(n))).join(blocks.withColumn("_key", F.explode(_upto(PER_KEY))), ["_n", "_key"])
    return met.select("_queries", "_blob").mapInArrow(_comparer(width, k, scale), FOUND)


SHARD = "_part long, _box binary, _tree binary, _asked binary"
FOUND = "query_id long, _hash long, vec_id long, score long"


def _sharder(split: Regions, width: int, count: bool = False):
    """The shard of each row, or how many rows of a batch each region has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("_v"), width)
            if count:
                region, n = np.unique(split.of(vectors), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(n)], ["region", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(split.shards(batch.column("_id").to_numpy(), vectors)), *batch.columns], ["_part", *batch.schema.names])

    return run


def _builder(width: int, k: int, query_every: int):
    """A shard's outer box and tree, and its own queries with what they find in it."""

    def run(table: pa.Table) -> pa.Table:
        ids, vectors = table["_id"].to_numpy(), _matrix(table["_v"], width)
        tree = build(ids, vectors)
        asked = np.flatnonzero(ids % query_every == 0)
        rows = np.unique(np.column_stack([ids[asked], vectors[asked]]), axis=0)
        mine, queries = rows[:, 0], rows[:, 1:]
        found = search(tree, mine, queries, k, np.full(len(mine), LOWEST))
        n = np.array([len(s) for _, s in found], np.int64)
        kth = np.array([s[-1] if len(s) == k else LOWEST for _, s in found], np.int64)
        vec, score = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        blobs = [A.pack(tree.low[0], tree.high[0]), A.pack(*(getattr(tree, f) for f in _FIELDS)), A.pack(mine, queries, kth, n, vec, score)]
        return pa.table({"_part": table["_part"].slice(0, 1), **{c: pa.array([x], pa.binary()) for c, x in zip(("_box", "_tree", "_asked"), blobs, strict=True)}})

    return run


_FIELDS = ("ids", "vectors", "first", "last", "left", "right", "low", "high")


def _tree(blob: bytes, width: int) -> Tree:
    ids, vectors, first, last, left, right, low, high = A.unpack(blob)
    return Tree(ids, vectors.reshape(-1, width), first, last, left, right, low.reshape(-1, width), high.reshape(-1, width))


def _boxes(table: pa.Table) -> pa.Table:
    """A group of outer boxes in one row."""
    boxes = [A.unpack(b) for b in table["_box"].to_pylist()]
    blob = A.pack(table["_part"].to_numpy(), np.concatenate([b[0] for b in boxes]), np.concatenate([b[1] for b in boxes]))
    return pa.table({"_group": table["_group"].slice(0, 1), "_boxes": pa.array([blob], pa.binary())})


def _asker(width: int):
    """For each block of queries and each shard but its own: those queries that can find something there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, low, high = A.unpack(row["_boxes"])
                ids, queries, kth = A.unpack(row["_asked"])[:3]
                queries, low, high = (x.reshape(-1, width) for x in (queries, low, high))
                kind = _kind(np.concatenate([low, high]), queries)
                open_ = (_bounds(queries, low, high, kind) >= kth[:, None]) | (kth == LOWEST)[:, None]
                open_[:, part == row["_part"]] = False
                to = np.flatnonzero(open_.any(axis=0))
                blobs = [A.pack(ids[x], queries[x], kth[x]) for x in open_.T[to]]
                n = len(to)
                yield pa.RecordBatch.from_arrays([pa.array(part[to]), pa.array(np.full(n, row["_part"])), A.blobs(blobs)], ["_part", "_from", "_blob"])

    return run


def _searcher(width: int, k: int):
    """Rows of a shard and salt come together: its tree, then blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, tree = None, None
        for batch in batches:
            for kind, blob in zip(batch.column("_kind").to_pylist(), batch.column("_blob"), strict=True):
                if kind == 0:
                    packed, tree = blob.as_py(), None
                    continue
                tree = tree or _tree(packed, width)
                ids, queries, kth = A.unpack(blob.as_py())
                queries = queries.reshape(-1, width)
                found = search(tree, ids, queries, k, kth)
                yield _rows(ids, queries, np.array([len(s) for _, s in found]), *(np.concatenate([f[i] for f in found]) for i in (0, 1)))

    return run


def _bits(x: int) -> int:
    """64 bits of a whole number: its own where it has no more."""
    return x % (1 << 64) if LOWEST <= x <= HIGHEST else int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "big")


def _rows(ids: np.ndarray, queries: np.ndarray, n: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    parts = queries.astype(np.uint64) if queries.dtype != object else np.array([[_bits(x) for x in q] for q in queries.tolist()], np.uint64).reshape(queries.shape)
    hashes = A.mix((parts * A._powers(0x9E3779B97F4A7C15, queries.shape[1])).sum(axis=1, dtype=np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(ids, n), np.repeat(hashes, n), vec, score)], ["query_id", "_hash", "vec_id", "score"])


def _at_home(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("_asked").to_pylist():
                ids, queries, _, n, vec, score = A.unpack(blob)
                yield _rows(ids, queries.reshape(-1, width), n, vec, score)

    return run


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, query_every: int = 50, scale: int = 256, per_shard: int = PER_SHARD) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; queries are the rows whose id is divisible by ``query_every``."""
    spark, mine = vectors.sparkSession, F.col(vector_col)
    all_ = vectors.select(F.col(id_col).cast("long").alias("_id"), mine.alias("_x")).filter(F.col("_id").isNotNull() & valid(F.col("_x")))
    rows = all_.filter(small(F.col("_x"), scale)).select("_id", whole_numbers(F.col("_x"), scale).alias("_v"))
    size = all_.agg(F.count_if(small(F.col("_x"), scale)).alias("n"), F.count("*").alias("all"), F.max(F.size("_x")).alias("width")).first()
    n, width = size["n"], max(1, size["width"] or 1)
    split = Regions(*(np.zeros(0, np.int64),) * 4, np.arange(2))
    if (n_regions := min(REGIONS, frames.parts(n, per_shard))) > 1:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width), max(4096, 16 * n_regions)))
        number = F.xxhash64("_v", "_id")
        # twice as many as needed are expected below this hash; it keeps the rows that are sorted in one task few
        few = rows.filter(number < (1 << 63) * (4 * most - n) // n) if n > 2 * most else rows
        sample = few.orderBy(number).limit(most).select("_v").toArrow()
        split = regions(_matrix(sample["_v"], width), n_regions)
        of = {r["region"]: r["n"] for r in rows.mapInArrow(_sharder(split, width, True), "region long, n long").groupBy("region").agg(F.sum("n").alias("n")).collect()}
        split.first = np.cumsum([0, *(frames.parts(of.get(i, 0), per_shard) for i in range(len(split.first) - 1))])
    n_shards = int(split.first[-1])
    tasks = frames.tasks(spark, 8 * width * n, TASK_BYTES)
    dealt = rows.mapInArrow(_sharder(split, width), "_part long, _id long, _v array<long>").repartition(tasks, "_part")
    shards = frames.stored(dealt.groupBy("_part").applyInArrow(_builder(width, k, query_every), SHARD))
    groups, keys = frames.parts(n_shards, PER_GROUP), frames.parts(n_shards, PER_KEY)
    boxes = shards.select("_part", "_box", F.pmod("_part", F.lit(groups)).alias("_group")).groupBy("_group").applyInArrow(_boxes, "_group long, _boxes binary").withColumn("_key", F.explode(_upto(keys)))
    blocks = shards.select("_part", "_asked", F.explode(_upto(groups)).alias("_group"), F.pmod(F.xxhash64("_part"), F.lit(keys)).alias("_key"))
    met = blocks.join(boxes, ["_group", "_key"]).repartition(tasks, "_part", "_group").select("_part", "_asked", "_boxes")
    asked = frames.stored(met.mapInArrow(_asker(width), "_part long, _from long, _blob binary"))
    copies = asked.groupBy("_part").agg(F.ceil(F.count("*") / PER_TREE).alias("_copies"))
    trees = shards.join(copies, "_part").select("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_salt"), F.lit(0).alias("_kind"), F.col("_tree").alias("_blob"))
    sent = asked.join(copies, "_part").select("_part", F.pmod(F.xxhash64("_from"), F.col("_copies")).alias("_salt"), F.lit(1).alias("_kind"), "_blob")
    away = trees.unionByName(sent).repartition(tasks, "_part", "_salt").sortWithinPartitions("_part", "_salt", "_kind").mapInArrow(_searcher(width, k), FOUND)
    found = away.unionByName(shards.select("_asked").mapInArrow(_at_home(width), FOUND))
    if size["all"] > n:
        doubles = all_.select("_id", F.col("_x").cast("array<double>").alias("_x"), small(F.col("_x"), scale).alias("_small"))
        asks = doubles.filter(F.pmod("_id", F.lit(query_every)) == 0).drop("_small").distinct()
        large = doubles.filter("not _small").drop("_small")
        for queries, candidates in ((asks, large), (asks.filter(~small(F.col("_x"), scale)), doubles.filter("_small").drop("_small"))):
            found = found.unionByName(_compared(queries, candidates, width, k, scale))
    order = Window.partitionBy("query_id", "_hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    told = F.when(F.col("score").isin(LOWEST, HIGHEST), F.raise_error(F.lit("a score needs more than 64 bits")).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", told.alias("score"))
