"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are quantised to integers and dealt to shards by a hash. Each shard's tree halves its
rows at the median of the widest dimension and keeps a tight box per node. A query goes
through a tree best first: a box bounds every inner product within it, and boxes that cannot
reach the k-th score found so far are skipped. Bounds and scores are exact: they are worked out
in the least kind of number (double, long, Python integer) that holds every sum of a block.
Queries start in one shard; the k-th score found there goes with them to all others.

Queries travel in blocks of bounded size, trees are bounded by the rows of a shard, and only
rows that reach the propagated k-th score come back.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; only vectors of one length are compared; repeated rows compete each, ties go to the
smaller id; a query never meets rows of its own id. Fewer candidates than k give fewer rows.
Components may have any finite size; a score beyond the range of a long counts as that end of
the range (2^63 - 1 with its sign), and ties there go to the smaller id like any others. Rows are
dealt to shards one by one, so an id that many rows share does not fill one. Other columns of the
input are ignored.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern.llm.common import lasting

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
#: Rows of a shard (expected) and of a tree's leaf, queries of a block, blocks of a task.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, STRIPE_BLOCKS = 4096, 128, 256, 64
#: Ends of the scores.
MOST = (1 << 63) - 1
LEAST = -MOST


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dims) of the vectors that take part, v being floor(256 * x) / 256.

    As a double this is exact whatever the size of x, which a long is not.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce((F.size(vector) > 0) & finite, F.lit(False))

    def steps(x):
        x = x.cast("double")  # from 2^45 on a double has no digits below 1 / 256
        return F.when(F.abs(x) < 2.0**45, F.floor(x * SCALE).cast("double") / SCALE).otherwise(x)

    return vectors.where(good).select("vec_id", F.transform(vector, steps).alias("v"), F.size(vector).alias("dims"))


def integers(values: np.ndarray) -> np.ndarray:
    """256 times the doubles whose bits are given, as longs, or as Python integers if one is too large."""
    x = np.ascontiguousarray(values).view("<f8")
    if np.abs(x).max(initial=0) < 2.0**53:
        return (x * SCALE).astype(np.int64)
    whole = [int(c * SCALE) if abs(c) < 2.0**45 else int(c) * SCALE for c in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def largest(whole: np.ndarray) -> int:
    return int(np.abs(whole).max(initial=0))


def in_range(sums: np.ndarray) -> np.ndarray:
    """Exact sums as longs, those beyond a long's range as its ends."""
    if sums.dtype == object:
        return np.minimum(np.maximum(sums, LEAST), MOST).astype(np.int64)
    return sums


class Tree:
    """Rows in leaf order, boxes of all nodes, and the row range of every leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        lows, highs, spans, kids = [], [], [], []
        todo = [(np.argsort(ids, kind="stable"), -1)]
        placed, at = np.empty(len(ids), np.int64), 0
        while todo:
            rows, parent = todo.pop()
            node = len(spans)
            if parent >= 0:
                kids[parent].append(node)
            own = points[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            kids.append([])
            wide = int(np.argmax(high - low))
            if len(rows) <= leaf or high[wide] == low[wide]:
                spans.append((at, at + len(rows)))
                placed[at : at + len(rows)] = rows
                at += len(rows)
                continue
            spans.append((0, 0))
            middle = np.partition(own[:, wide], len(rows) // 2)[len(rows) // 2]
            left = own[:, wide] < middle
            if not left.any():  # more than half of the rows lie at the least value
                left = own[:, wide] <= middle
            todo += [(rows[left], node), (rows[~left], node)]
        self.ids, self.points = ids[placed], points[placed]
        self.low, self.high = np.array(lows), np.array(highs)
        self.spans, self.kids, self.largest = spans, kids, largest(points)

    def most(self, queries: np.ndarray) -> int:
        """A size that no component and no sum of products with these queries exceeds."""
        return max(largest(queries), 1) * max(self.largest, 1) * queries.shape[-1]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product each query could have within each node's box."""
        most = self.most(queries)
        kind = np.float64 if most < 1 << 53 else np.int64 if most <= MOST else object
        q, low, high = (x.astype(kind) for x in (queries, self.low, self.high))
        return in_range(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, least: int, own: int) -> list[tuple[int, int]]:
        """The best k of (score, -id) that reach ``least``, rows of id ``own`` left out."""
        found: list[tuple[int, int]] = []
        floor, kind = least, np.int64 if self.most(query) <= MOST else object
        query = query.astype(kind)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bounds[kid] >= floor:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            a, b = self.spans[node]
            scores = in_range(self.points[a:b].astype(kind, copy=False) @ query)
            near = np.flatnonzero((scores >= floor) & (self.ids[a:b] != own))
            if len(near) > k:
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[:k]]
            for i in near:
                hit = (int(scores[i]), -int(self.ids[a + i]))
                if len(found) < k:
                    heapq.heappush(found, hit)
                elif hit > found[0]:
                    heapq.heapreplace(found, hit)
            if len(found) == k:
                floor = max(floor, found[0][0])
        return found


def packed(rows: DataFrame, key: list[str], heads: list[str]) -> DataFrame:
    """One row per key and dimension: its ids, ``heads`` and the bits of its vectors as one block of longs."""
    shape = rows.select(*key, "dims").schema.add("rows", "binary")

    def pack(values, group):
        dims = group.column("dims")[0].as_py()
        points = np.asarray(group.column("v").combine_chunks().flatten()).view("<i8").reshape(-1, dims)
        whole = np.column_stack([*(np.asarray(group.column(c)) for c in ("vec_id", *heads)), points]).astype("<i8")
        whole = whole[np.lexsort(whole.T[::-1])]
        ids = [pa.array([group.column(c)[0].as_py()], group.column(c).type) for c in (*key, "dims")]
        return pa.table([*ids, pa.array([whole.tobytes()], pa.binary())], [*key, "dims", "rows"])

    return rows.groupBy(*key, "dims").applyInArrow(pack, shape)


def searched(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of blocks of queries in the trees of their unit.

    Both have (unit, shard, dims, rows). A task gets the tree of a unit before its blocks, so
    a tree travels once per unit and one block is held at a time.
    """

    def batches(given):
        at, tree = None, None
        for batch in given:
            for row in batch.to_pylist():
                place = (row["unit"], row["dims"])
                if row["kind"] == 0:
                    whole = np.frombuffer(row["rows"], "<i8").reshape(-1, row["dims"] + 1)
                    at, tree = place, Tree(whole[:, 0], integers(whole[:, 1:]))
                elif at == place:  # else no vector of this length lies in the shard
                    whole = np.frombuffer(row["rows"], "<i8").reshape(-1, row["dims"] + 3)
                    whole = whole[whole[:, 2] != row["shard"]]
                    vectors = integers(whole[:, 3:])
                    asked_for = zip(whole, vectors, tree.bounds(vectors), strict=True)
                    hits = [(q[0], -n, s) for q, v, b in asked_for for s, n in tree.search(v, b, k, int(q[1]), int(q[0]))]
                    columns = np.array(hits, np.int64).reshape(-1, 3).T
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    columns = ("unit", "shard", "dims", "rows")
    both = trees.select(*columns, F.lit(0).alias("kind")).unionByName(asked.select(*columns, F.lit(1).alias("kind")))
    ordered = both.repartition("unit").sortWithinPartitions("unit", "dims", "kind")
    return ordered.mapInArrow(batches, "query_id long, vec_id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asked: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every vector that ``asked`` picks.

    Repeated rows of one query id give one result, the best of all.
    """
    rows = lasting(quantised(vectors))
    shards = max(1, -(-rows.count() // shard_rows))
    # the rows are read from a table as written, so a row's number stays the same
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    trees = lasting(packed(rows.withColumn("shard", dealt), ["shard"], []))
    queries = rows.where(asked).dropDuplicates(["vec_id", "v"])
    queries = queries.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))

    alone = F.lit(LEAST).alias("least"), F.lit(-1).cast("long").alias("home")
    home = packed(queries.select("vec_id", "v", "dims", "shard", *alone), ["shard"], ["least", "home"])
    by_shard = F.col("shard").cast("long").alias("unit")
    first = lasting(_best(searched(trees.select("*", by_shard), home.select("*", by_shard), k), k))

    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    told = queries.join(floors, queries.vec_id == floors.query_id, "left").select(
        "vec_id", "v", "dims", F.coalesce("kth", F.lit(LEAST)).alias("least"), F.col("shard").cast("long").alias("home")
    )
    blocks = max(1, -(-queries.count() // block_rows))
    stripes = -(-blocks // STRIPE_BLOCKS)
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).alias("block")
    asked_blocks = packed(told.select("*", block), ["block"], ["least", "home"])
    every = asked_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    unit = (F.col("shard") * F.lit(stripes) + F.pmod("block", F.lit(stripes))).cast("long").alias("unit")
    copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    rest = searched(copies.select("*", unit), every.select("*", unit), k)
    hits = first.select("query_id", "vec_id", "score").unionByName(rest)
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
