"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Every vector component x becomes the integer ``floor(scale * x)``.  The vectors are dealt to
tasks; each task builds ball trees over shards of at most ``shard_rows`` of its vectors and
searches them for a block of queries.  No ball holds a vector whose inner product with q is
over q . centre + |q| * radius, nor over |q| times its longest vector times the cosine of q's
angle to the narrowest cone around the centre that holds the ball's vectors.  The lesser of the
two is the ball's bound; balls are visited from the highest bound down, with the
queries that can still gain, and a query leaves a ball whose bound is under its current kth
score.  That score starts from a bounded sample of large vectors, and goes on from ball to
ball and from shard to shard of the task.  The tasks' best k of each query are merged by a
window over the query, which Spark limits to k rows before its shuffle.

Queries are taken in blocks of at most ``block`` of a stated query set; a block is broadcast,
so its size is bounded, and each block is one lazy plan over all vectors.

Defined results: a vector that is null or holds a null or non-finite component takes no part.
Vectors of another length than the query's take no part in its result.  Rows with the query's
own id are not candidates; other repeated rows are candidates each.  Where several rows have
one query id, the smallest vector is the query.  Ties go to the smaller id.  With fewer than
k candidates all are returned; an empty table gives no row.  Scores are exact while a sum of
absolute products is below 2**63.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score long"


def quantised(vector: str, scale: int) -> Column:
    """The integer vector, or null where it takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer rows; in floats where these are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The best k of each query so far; ``floor`` is its kth score or a lower bound of it."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.row = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int = 50_000) -> None:
        self.new.append((row, ids, score))
        self.waiting += len(row)
        if self.waiting > most:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        row, ids, score = (np.concatenate([old, *[x[i] for x in self.new]]) for i, old in enumerate((self.row, self.id, self.score)))
        self.new, self.waiting = [], 0
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, row, side="left")
        kept = np.arange(len(row)) - first < self.k
        self.row, self.id, self.score = row[kept], ids[kept], score[kept]
        at, n = np.unique(self.row, return_counts=True)
        full = at[n == self.k]
        last = np.searchsorted(self.row, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


class BallTree:
    """Vectors in the order of their leaves; a node is a range of them with a ball around it."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.order = np.arange(len(vectors))
        self.vectors = vectors.astype(np.float64)
        lengths = np.sqrt((self.vectors**2).sum(axis=1))
        self.start, self.end, self.children, centres, radii, longest, cosines = [], [], [], [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.start)
            if parent >= 0:
                self.children[parent].append(node)
            own = self.vectors[self.order[a:b]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            self.start.append(a), self.end.append(b), self.children.append([]), centres.append(centre)
            radii.append(away.max())
            size, middle = lengths[self.order[a:b]], np.sqrt((centre**2).sum())
            longest.append(size.max())
            cosines.append(float((own @ centre / (size * middle)).min()) if size.min() > 0 and middle > 0 else -1.0)
            if b - a > leaf and away.max() > 0:
                pole = own[away.argmax()]
                other = own[((own - pole) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own @ (other - pole), half)]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.longest, self.cosines = np.array(longest), np.clip(cosines, -1.0, 1.0)

    def bounds(self, queries: np.ndarray, rows: int = 2048) -> np.ndarray:
        """No vector of a node (column) has a larger product with a query (row); made in blocks of rows."""
        found = np.empty((len(queries), len(self.radii)))
        middle = np.sqrt((self.centres**2).sum(axis=1))
        sines = np.sqrt(1 - self.cosines**2)
        for a in range(0, len(queries), rows):
            some = queries[a : a + rows].astype(np.float64)
            norms = np.sqrt((some**2).sum(axis=1))[:, None]
            along = some @ self.centres.T
            angle = np.clip(along / np.maximum(norms * middle, 1e-300), -1.0, 1.0)
            edge = np.where(angle >= self.cosines, 1.0, angle * self.cosines + np.sqrt(1 - angle**2) * sines)
            # slack for rounding: scores are integers and bounds are floats
            ball = along + norms * (self.radii + 1e-9 * (self.radii + middle))
            cone = norms * self.longest * (np.maximum(edge, 0.0) + 1e-6)
            found[a : a + rows] = np.minimum(ball, cone) + 1e-3
        return found

    def search(self, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best) -> int:
        """Offer ``best`` all that can be in it; returns the number of pairs scored."""
        bounds, scored = self.bounds(queries), 0
        heap = [(-bounds[:, 0].max(), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            active = np.flatnonzero(bounds[:, node] >= best.floor)
            if not len(active):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    above = bounds[active, child]
                    if (above >= best.floor[active]).any():
                        heapq.heappush(heap, (-above.max(), child))
                continue
            rows = self.order[self.start[node] : self.end[node]]
            score = exact_product(queries[active], vectors[rows])
            scored += score.size
            take = (score >= best.floor[active][:, None]) & (query_ids[active][:, None] != ids[rows][None, :])
            i, j = np.nonzero(take)
            if len(i):
                best.offer(active[i], ids[rows[j]], score[i, j])
        return scored


def _search(batches: Iterator[pa.RecordBatch], shared, k: int, shard_rows: int, leaf: int) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, tuple] = shared.value  # by vector length: ids, vectors, floors
    best = {n: Best(floor, k) for n, (_, _, floor) in blocks.items()}
    held: dict[int, tuple[list, list]] = {n: ([], []) for n in blocks}

    def look(n: int) -> None:
        ids, vectors = held[n]
        if ids:
            ids, vectors = np.concatenate(ids), np.concatenate(vectors)
            for a in range(0, len(ids), shard_rows):
                part, own = vectors[a : a + shard_rows], ids[a : a + shard_rows]
                BallTree(part, leaf).search(blocks[n][1], blocks[n][0], part, own, best[n])
                best[n].merge()
            held[n] = ([], [])

    waiting = 0
    for batch in batches:
        ids = np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False))
        column = batch.column("vector")
        lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
        flat, offsets = np.asarray(column.flatten().to_numpy(zero_copy_only=False)), np.concatenate(([0], np.cumsum(lengths)))
        for n in set(lengths.tolist()) & set(blocks):
            at = np.flatnonzero(lengths == n)
            held[n][0].append(ids[at])
            held[n][1].append(flat[offsets[at][:, None] + np.arange(n)[None, :]])
        waiting += len(ids)
        if waiting >= shard_rows:
            for n in blocks:
                look(n)
            waiting = 0
    for n, (query_ids, _, _) in blocks.items():
        look(n)
        b = best[n]
        for a in range(0, len(b.row), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[b.row[part]]), pa.array(b.id[part]), pa.array(b.score[part])], names=["query_id", "vec_id", "score"]
            )


def top_k(
    table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding",
    block: int = 16_384, shard_rows: int = 16_384, leaf: int = 128, sample: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query row."""
    spark = table.sparkSession
    marked = table.select(F.col(key).cast("long").alias("vec_id"), quantised(vector, scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    ready = marked.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    vectors = ready.select("vec_id", "vector")
    queries = ready.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    # a bounded sample (the largest vectors) gives each query a first lower bound of its kth score
    large = vectors.orderBy(size.desc(), "vec_id").limit(sample).collect() if sample else []
    n = queries.count()
    n_blocks = -(-n // block)
    plans = []
    for number in range(n_blocks):
        own = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number)
        rows = own.collect()  # about ``block`` rows
        blocks = {}
        for length in {len(r["vector"]) for r in rows}:
            ids = np.array([r["vec_id"] for r in rows if len(r["vector"]) == length], dtype=np.int64)
            values = np.array([r["vector"] for r in rows if len(r["vector"]) == length], dtype=np.int64).reshape(len(ids), length)
            floor = np.full(len(ids), np.iinfo(np.int64).min)
            some = [r for r in large if len(r["vector"]) == length]
            if len(some) > k:
                score = exact_product(values, np.array([r["vector"] for r in some], dtype=np.int64))
                score[ids[:, None] == np.array([r["vec_id"] for r in some])[None, :]] = np.iinfo(np.int64).min
                floor = np.partition(score, len(some) - k, axis=1)[:, len(some) - k]
            blocks[length] = (ids, values, floor)
        shared = spark.sparkContext.broadcast(blocks)
        search = functools.partial(_search, shared=shared, k=k, shard_rows=shard_rows, leaf=leaf)
        plans.append(vectors.mapInArrow(search, RESULT))
    if not plans:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.unionByName, plans)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
