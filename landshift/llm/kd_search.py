"""Exact top-k inner products over KD-trees per shard (operator 1).

Every shard of the vectors is a KD-tree: median splits along the widest side, with the tight bounding
box of every node. A query goes through a tree best box first, by the largest inner product that a
box allows, and stops where that is below its k-th score. Queries first search their own shard; the
k-th score found there goes along to all other shards, which search only what can beat it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.session import cut_lineage

#: Rows of a shard, queries of a block, rows of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 16_384, 2_048, 256
NONE = np.iinfo(np.int64).min


class Tree:
    """KD-tree of whole-number vectors; rows are put in leaf order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        order = np.lexsort((ids,))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int]] = []
        self.order: list[np.ndarray] = []
        self.placed = 0
        if len(ids):
            self._build(vectors, order)
        at = np.concatenate(self.order) if self.order else order
        self.ids, self.vectors = ids[at], vectors[at]
        self.low, self.high = (np.array(x, np.int64).reshape(len(self.span), vectors.shape[1]) for x in (self.low, self.high))

    def _build(self, vectors: np.ndarray, rows: np.ndarray) -> int:
        """Adds a node over ``rows``; equal vectors stay one leaf, as no split can part them."""
        node, stack = -1, [(rows, -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            held = vectors[rows]
            low, high = held.min(axis=0), held.max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((0, 0))
            self.child.append((-1, -1))
            if parent >= 0:
                a, b = self.child[parent]
                self.child[parent] = (node, b) if side == 0 else (a, node)
            wide = int((high - low).argmax()) if len(low) else 0
            if len(rows) <= self.leaf or not len(low) or high[wide] == low[wide]:
                self.span[node] = (self.placed, self.placed + len(rows))
                self.placed += len(rows)
                self.order.append(rows)
                continue
            value = held[:, wide]
            middle = np.partition(value, len(rows) // 2)[len(rows) // 2]
            left = value < middle if (value < middle).any() else value <= middle
            stack.append((rows[~left], node, 1))
            stack.append((rows[left], node, 0))
        return node

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best rows with another id, ties to smaller ids.

        ``bound``: a score below which a row can't be among a query's k best.
        """
        if not len(self.span) or not len(query_ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = np.full(len(query_ids), NONE) if bound is None else bound
        kind = _kind(queries, self.vectors)
        q = queries.astype(kind)
        rows = self.vectors.astype(kind)
        reach = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(query_ids)):
            ids, scores = self._best_first(int(query_ids[i]), q[i], rows, reach[i], k, int(bound[i]))
            out.append((np.full(len(ids), i), ids, scores))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _best_first(self, own: int, q: np.ndarray, rows: np.ndarray, reach: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-reach[0], 0)]
        while heap and -heap[0][0] >= bound:
            _, node = heapq.heappop(heap)
            a, b = self.child[node]
            if a >= 0:
                for c in (a, b):
                    if reach[c] >= bound:
                        heapq.heappush(heap, (-reach[c], c))
                continue
            a, b = self.span[node]
            score = (rows[a:b] @ q).astype(np.int64)
            near = (score >= bound) & (self.ids[a:b] != own)
            if not near.any():
                continue
            best = np.concatenate([best, score[near]])
            best_ids = np.concatenate([best_ids, self.ids[a:b][near]])
            if len(best) > k:
                order = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[order], best_ids[order]
            if len(best) == k:
                bound = max(bound, int(best.min()))
        return best_ids, best


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where all sums of products are exact in them, else 64-bit whole numbers."""
    size = max(1, a.shape[1]) * (float(np.abs(a).max(initial=0)) + 1) * (float(np.abs(b).max(initial=0)) + 1)
    return np.float64 if size < 2.0**52 else np.int64


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<long>, dim) with floor(scale * x); rows that are null or hold a null or non-finite number are left out."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(fine)
        .select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim")).distinct())


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dim)


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows with another id, over all rows of its dimension.

    Repeated equal rows count once; rows of one id with unlike vectors are rows of their own, and a
    query never finds its own id. Shards and query blocks are chosen by hashes, with a number that
    grows with the table, so a task holds one shard and one block.
    """
    spark = rows.sparkSession
    size = rows.count()
    shards, blocks = -(-size // shard_rows) or 1, max(1, -(-rows.where(is_query).count() // query_rows))
    named = rows.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("query", F.lit(True))
    seed = F.xxhash64("id", "v")
    table = cut_lineage(
        whole_vectors(rows, id_col, vector).join(named, "id", "left")
        .select("id", "v", "dim", F.coalesce("query", F.lit(False)).alias("query"),
                F.pmod(seed, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(seed, 32), F.lit(blocks)).alias("block")))
    found = "query_id long, id long, score long, dim int, block long"

    def own(key, part):
        dim = key[1].as_py()
        ids, vectors = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
        asks = part.column("query").to_numpy()
        q, hit, score = Tree(ids, vectors, leaf).search(ids[asks], vectors[asks], k)
        return _found(ids[asks], q, hit, score, dim, part.column("block").to_numpy()[asks])

    first = cut_lineage(table.groupBy("shard", "dim").applyInArrow(own, found))
    # the k-th score in the own shard, for queries that have k there
    reached = first.groupBy("query_id", "dim", "block").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    queries = cut_lineage(table.where("query").drop("query").join(
        reached.select(F.col("query_id").alias("id"), "dim", "block", F.when(F.col("n") >= k, F.col("least")).alias("bound")),
        ["id", "dim", "block"], "left"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("to"), "id", "v", "dim", "block", "bound", F.col("shard").alias("home"))
    asked = asked.where(F.col("to") != F.col("home")).drop("home").withColumnRenamed("to", "shard")
    stored = table.select("id", "v", "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def other(key, left, right):
        dim = key[1].as_py()
        ids, asking = left.column("id").to_numpy(), right.column("id").to_numpy()
        bound = right.column("bound").fill_null(NONE).to_numpy()
        tree = Tree(ids, _matrix(left.column("v"), dim), leaf) if len(asking) else Tree(ids[:0], np.zeros((0, dim), np.int64))
        q, hit, score = tree.search(asking, _matrix(right.column("v"), dim), k, bound)
        return _found(asking, q, hit, score, dim, right.column("block").to_numpy())

    keys = ["shard", "dim", "block"]
    rest = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(other, found)
    every = first.unionByName(rest).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))), 1, k).alias("best"))
    return every.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _found(asking: np.ndarray, q: np.ndarray, hit: np.ndarray, score: np.ndarray, dim: int, block: np.ndarray) -> pa.Table:
    return pa.table({
        "query_id": pa.array(asking[q], pa.int64()), "id": pa.array(hit, pa.int64()), "score": pa.array(score, pa.int64()),
        "dim": pa.array(np.full(len(q), dim), pa.int32()), "block": pa.array(block[q], pa.int64())})


def op1_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
