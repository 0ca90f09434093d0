"""Exact nearest vectors by inner product: a KD-tree for each shard, searched best box first.

Rows are dealt out over shards of a bounded size, each with a tree of median splits and tight boxes. A query meets every shard:
first the most promising leaf of each, which gives a score that its k-th best reaches at least; then, with that
score handed to all shards, the rest of each tree, as far as a box can still hold something as good.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, unstage
from ledgerloom.llm.vectors import product_limit, usable, whole

#: Components that a shard, and a block of queries, hold about at most; rows of a leaf.
SHARD, QUERIES, LEAF = 1 << 20, 1 << 18, 256
TREE = "shard int, dim int, ids array<bigint>, rids array<bigint>, points binary, begin array<int>, left array<int>, low binary, high binary"
BLOCK = "block int, dim int, ids array<bigint>, rids array<bigint>, floors array<bigint>, points binary"
FOUND = "query_rid bigint, query_id bigint, vec_id bigint, rid bigint, score bigint"


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, begin, left, low, high): rows of `x` in the order of the leaves, and for each node where its rows begin (the next entry
    of the last level tells where they end), its left child (the right one follows; -1 at a leaf) and its box. Nodes are
    split at the median of their widest side; equal rows are split too."""
    order = np.arange(len(x))
    spans, left, low, high = [(0, len(x))], [], [], []
    for start, end in spans:
        own = x[order[start:end]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        if end - start <= leaf:
            left.append(-1)
            continue
        half = (end - start) // 2
        by = np.argpartition(own[:, np.argmax(high[-1] - low[-1])], half)
        order[start:end] = order[start:end][by]
        left.append(len(spans))
        spans += [(start, start + half), (start + half, end)]
    return order, np.array(spans, np.int32).reshape(-1), np.array(left, np.int32), np.array(low), np.array(high)


def _numbers(x: pa.ChunkedArray) -> np.ndarray:
    return x[0].values.to_numpy(zero_copy_only=False)


def _plant(table: pa.Table) -> pa.Table:
    """The tree of a shard's rows (shard, dim, rid, vec_id, embedding), as one row."""
    dim = table["dim"][0].as_py()
    x = whole(table["embedding"], dim, product_limit(dim))
    order, begin, left, low, high = build_tree(x)
    rows = table.take(pa.array(order))
    blob = lambda a: np.ascontiguousarray(a, np.int64).tobytes()
    one = [[table["shard"][0].as_py()], [dim], [rows["vec_id"].to_pylist()], [rows["rid"].to_pylist()], [blob(x[order])], [begin.tolist()], [left.tolist()], [blob(low)], [blob(high)]]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(one, kinds, strict=True)], names=[f.split()[0] for f in TREE.split(", ")])


def _gather(table: pa.Table) -> pa.Table:
    """A block of queries (block, dim, rid, vec_id, floor, embedding), as one row."""
    dim = table["dim"][0].as_py()
    x = whole(table["embedding"], dim, product_limit(dim))
    one = [[table["block"][0].as_py()], [dim], [table["vec_id"].to_pylist()], [table["rid"].to_pylist()], [table["floor"].to_pylist()], [x.tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(one, kinds, strict=True)], names=[f.split()[0] for f in BLOCK.split(", ")])


def _best_first(bounds: np.ndarray, begin: np.ndarray, left: np.ndarray, points: np.ndarray, q: np.ndarray, rank: np.ndarray, own: int, floor: float, k: int, leaves: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best rows for `q` that reach `floor`, equal scores by `rank`, without the row `own`. At most so many
    `leaves` are opened, if that is given."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, points.dtype)
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < floor:
            break
        if left[node] >= 0:
            for child in (int(left[node]), int(left[node]) + 1):
                if bounds[child] >= floor:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        start, end = begin[2 * node], begin[2 * node + 1]
        s = points[start:end] @ q
        good = np.flatnonzero(s >= floor)
        new = good + start
        if start <= own < end:
            good, new = good[new != own], new[new != own]
        if len(new):
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, s[good]])
            by = np.lexsort((rank[rows], -scores))[:k]
            rows, scores = rows[by], scores[by]
            if len(rows) == k:
                floor = max(floor, scores[-1])
        if leaves is not None:
            leaves -= 1
            if not leaves:
                break
    return rows, scores


def _search(k: int, leaves: int | None):
    """A function of a shard's tree and a block of queries: the best rows of the shard for each query."""

    def run(tree: pa.Table, block: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 5, names=[f.split()[0] for f in FOUND.split(", ")])
        if not tree.num_rows or not block.num_rows:
            return none
        dim = tree["dim"][0].as_py()
        read = lambda t, c: np.frombuffer(t[c][0].as_py(), np.int64).reshape(-1, dim) if dim else np.zeros((len(t["rids"][0]), 0), np.int64)
        points, low, high, q = read(tree, "points"), read(tree, "low"), read(tree, "high"), read(block, "points")
        if not dim:
            low = high = np.zeros((len(tree["left"][0]), 0), np.int64)
        # Doubles are exact as long as every sum stays under 2^53, and much faster.
        if max(1, np.abs(points).max(initial=0)) * max(1, int(np.abs(q).max(initial=0))) * dim < 1 << 53:
            points, low, high, q = (a.astype(np.float64) for a in (points, low, high, q))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        begin, left, rids = _numbers(tree["begin"]), _numbers(tree["left"]), _numbers(tree["rids"])
        ids = tree["ids"][0].values
        keys = np.array([2**63 - 1 if v is None else v for v in ids.to_pylist()], np.int64)
        rank = np.empty(len(rids), np.int64)
        rank[np.lexsort((rids, keys, np.array(ids.is_null())))] = np.arange(len(rids))
        place = {r: i for i, r in enumerate(rids.tolist())}
        of, rows, scores = [], [], []
        floors, own = block["floors"][0].as_py(), _numbers(block["rids"]).tolist()
        for i in range(len(q)):
            r, s = _best_first(bounds[i], begin, left, points, q[i], rank, place.get(own[i], -1), float("-inf") if floors[i] is None else floors[i], k, leaves)
            of.append(np.full(len(r), i))
            rows.append(r)
            scores.append(s)
        of, rows, scores = pa.array(np.concatenate(of).astype(np.int64)), np.concatenate(rows).astype(np.int64), np.concatenate(scores).astype(np.int64)
        return pa.table([block["rids"][0].values.take(of), block["ids"][0].values.take(of), ids.take(pa.array(rows)), pa.array(rids[rows]), pa.array(scores)], names=none.column_names)

    return run


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """The queries (rid, vec_id, dim, embedding, floor) in blocks, a row each."""
    return queries.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).groupBy("block", "dim").applyInArrow(_gather, BLOCK)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` holds for, the k rows of the largest inner product of
    components floor(1024 * x), ties to the smaller id, itself left out; all, if there are fewer.

    Vectors that are null or hold null or non-finite components take no part; a query meets vectors of its own length only (empty
    ones score 0 with each other). Rows that repeat an id are rows of their own, as queries and as candidates; a null id comes
    last among ties. Components are held within the square root of 2^62 / length, where products leave 64 bits (262,144 a unit
    vector's length in 64 dimensions). An empty table gives no rows; other columns are not looked at.
    """
    rows = usable(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("embedding").alias("dim"), "embedding", "asks"), "topk-rows")
    asks = rows.where("asks").drop("asks")
    size = rows.agg(F.sum(F.greatest("dim", F.lit(1))).alias("all"), F.sum(F.when(F.col("asks"), F.greatest("dim", F.lit(1)))).alias("asked")).first()
    shards, blocks = -(-(size["all"] or 1) // SHARD), -(-(size["asked"] or 1) // QUERIES)
    trees = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).groupBy("shard", "dim").applyInArrow(_plant, TREE)
    trees = staged(trees, "topk-trees")

    def search(queries: DataFrame, leaves: int | None) -> DataFrame:
        # Each block of queries goes to each shard; a tree goes to the blocks it meets, which are many only where queries are.
        over = staged(_blocks(queries, blocks), "topk-queries")
        left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = over.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        met = left.groupBy("shard", "dim", "block").cogroup(right.groupBy("shard", "dim", "block")).applyInArrow(_search(k, leaves), FOUND)
        out = staged(met, "topk-found")
        unstage(over)
        return out

    none = F.lit(None).cast("long").alias("floor")
    first = search(asks.select("rid", "vec_id", "dim", "embedding", none), 1)
    nth = Window.partitionBy("query_rid").orderBy(F.desc("score"))
    floors = first.select("query_rid", "score", F.row_number().over(nth).alias("n")).where(F.col("n") == k).select(F.col("query_rid").alias("rid"), F.col("score").alias("floor"))
    found = search(asks.join(floors.hint("merge"), "rid", "left").select("rid", "vec_id", "dim", "embedding", "floor"), None)
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
