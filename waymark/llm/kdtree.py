"""Exact top-k by inner product: a KD-tree in each shard, searched best first.

Trees split at medians by rank, down to leaves or equal points, and keep tight bounding boxes; a box's
bound is the largest inner product that any point of it can have with the query. Nodes are opened
in the order of bounds until the bound falls below the kth score so far. That score goes from shard to
shard: a task hands the best so far on to its next tree, and a first round over a part of the shards
gives all tasks of the second one the kth score that it reached.

Components become ``floor(256 * x)`` as 64-bit integers, and scores are exact: in doubles or 64-bit
integers where sizes allow it, else in whole numbers of any size. What 64 bits can't hold, a component
or a score that is to be returned, is an error. Vectors that are null, empty, or hold null or
non-finite components take no part, nor do rows without an identifier; vectors meet those of their
own length only. Ties go to the smaller identifier; rows of one identifier are one candidate each, exact
repeats too, but never their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import batches, written

#: Vectors in a shard, points in a leaf; bytes of the queries that go around at a time.
SHARD, LEAF, QUERY_BYTES = 16384, 128, 64 << 20
#: One shard in so many is searched in the first round.
FIRST = 16


def _most(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0


def _dot(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact products of whole numbers; ``most`` bounds what a sum's parts can add up to."""
    if most <= 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64)
    if most <= 2.0**62:
        return a @ b
    return a.astype(object) @ b.astype(object)


class Tree:
    """Points in the order of leaves, and for each node its rows, box, least identifier and children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.rows, self.kids, self.least = [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            lo, hi = own.min(0), own.max(0)
            node = len(self.rows)
            self.low.append(lo), self.high.append(hi), self.rows.append((a, b)), self.kids.append([-1, -1]), self.least.append(ids[order[a:b]].min())
            if parent >= 0:
                self.kids[parent][side] = node
            if b - a > leaf and (hi > lo).any():
                axis, half = int((hi - lo).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.most = _most(points) * max(1, points.shape[1])
        if self.most <= 2.0**53:  # doubles from the start, where any product with small queries may be exact
            self.points = self.points.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query can score in each node."""
        most = self.most * _most(queries)
        return _dot(np.maximum(queries, 0), self.high.T, most) + _dot(np.minimum(queries, 0), self.low.T, most)

    def scores(self, rows: slice, q: np.ndarray, most: float) -> np.ndarray:
        points = self.points[rows]
        if most > 2.0**53 and points.dtype == np.float64:
            points = points.astype(np.int64)
        return _dot(points, q, most)

    def search(self, qid: int, q: np.ndarray, bounds: np.ndarray, k: int, best: list[tuple[int, int]], floor: int | None) -> None:
        """Put what is better into ``best``, a heap of ``score, -id`` with the worst first. ``floor``: a score that k others reach already."""
        heap, most = [(-int(bounds[0]), 0)], self.most * _most(q)
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            least = best[0][0] if len(best) == k else None
            if floor is not None and (least is None or floor > least):
                least = floor
            if least is not None and bound < least:
                break
            if len(best) == k and bound == best[0][0] and self.least[node] > -best[0][1]:
                continue
            if self.kids[node][0] >= 0:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-int(bounds[kid]), kid))
                continue
            a, b = self.rows[node]
            scores = self.scores(slice(a, b), q, most)
            at = np.nonzero(self.ids[a:b] != qid)[0]
            if least is not None:
                at = at[scores[at] >= least]
            if len(at) > k:
                at = at[np.lexsort((self.ids[a:b][at], -scores[at]))[:k]]
            for i in at:
                item = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: usable vectors as whole numbers."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    big = F.lit("a component of floor(256 * x) doesn't fit in 64 bits")
    v = F.transform(x, lambda c: F.when(F.abs(c * 256) < F.lit(2.0**63), F.floor(c * 256)).otherwise(F.raise_error(big).cast("bigint")))
    return vectors.where(fine).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"))


def _by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    return {int(n): (np.array([ids[i] for i in np.nonzero(sizes == n)[0]], np.int64), np.array([vectors[i] for i in np.nonzero(sizes == n)[0]], np.int64)) for n in np.unique(sizes)}


def _matrix(column) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _build_batches(rows):
    """A tree for each length of vectors in the shard; shards have about SHARD rows."""
    import pyarrow as pa

    ids, vectors = [], []
    for b in batches(rows):
        ids += b.column(0).to_pylist()
        vectors += _matrix(b.column(1))
    for n, (i, v) in _by_length(ids, vectors).items():
        for a in range(0, len(i), SHARD * 4):  # should rows fall unevenly, no tree grows beyond that
            tree = Tree(i[a : a + SHARD * 4], v[a : a + SHARD * 4])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], names=["dims", "tree"])


def build(vectors: DataFrame, shards: int | None = None) -> DataFrame:
    """``dims, tree``: the index, a row for each tree, written to the shared folder. Every row is indexed."""
    n = shards or max(1, -(-vectors.count() // SHARD))
    return written(vectors.repartition(n, "id", F.xxhash64("v")).mapInArrow(_build_batches, "dims int, tree binary"), "trees")


def _search_batches(rows, shared, k: int):
    """Trees of a task, one after another; each query's best so far goes with it."""
    import pyarrow as pa

    queries = shared.value
    best = {dims: [[] for _ in ids] for dims, (ids, _, _) in queries.items()}
    for b in batches(rows):
        for dims, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if dims not in queries:
                continue
            tree, (ids, q, floors) = pickle.loads(raw.as_py()), queries[dims]
            for a in range(0, len(ids), 256):
                bounds = tree.bounds(q[a : a + 256])
                for j in range(a, min(a + 256, len(ids))):
                    tree.search(int(ids[j]), q[j], bounds[j - a], k, best[dims][j], floors[j])
    for dims, (ids, _, _) in queries.items():
        found = [(j, s, -i) for j, heap in enumerate(best[dims]) for s, i in heap]
        for a in range(0, len(found), 10_000):
            at, scores, others = zip(*found[a : a + 10_000], strict=True)
            if max(scores) >= 1 << 63 or min(scores) < -(1 << 63):
                raise OverflowError("a score doesn't fit in 64 bits")
            # the place tells repeated queries apart
            yield pa.RecordBatch.from_arrays([pa.array(ids[list(at)]), pa.array([dims] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(others, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "dims", "place", "vec_id", "score"])


_FOUND = "query_id bigint, dims int, place int, vec_id bigint, score bigint"


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(index: DataFrame, block: list, k: int) -> DataFrame:
    """What a block of queries finds, in two rounds over the index; at most ``k`` rows a query and task."""
    spark = index.sparkSession
    q = {n: (ids, v, [None] * len(ids)) for n, (ids, v) in _by_length([r["id"] for r in block], [np.array(r["v"], np.int64) for r in block]).items()}
    mark = F.pmod(F.xxhash64(F.md5("tree")), F.lit(FIRST)) == 0
    run = lambda part: written(part.mapInArrow(partial(_search_batches, shared=spark.sparkContext.broadcast(q), k=k), _FOUND), "found")
    first = run(index.where(mark))
    for r in _best(first, k, "dims", "place").where(F.col("rank") == k).select("dims", "place", "score").toLocalIterator():  # a row a query of the block at most
        q[r["dims"]][2][r["place"]] = r["score"]
    return _best(first.union(run(index.where(~mark))), k, "query_id", "dims", "place").drop("dims", "place", "rank")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shards: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's best among all rows but its own, exactly.

    Repeated rows take a rank each, as in the query's SQL; so do those of repeated queries.

    ``vectors`` and ``queries`` are ``id, v`` as :func:`quantised` gives them. Queries go around in
    blocks of ``query_bytes``, so what the driver holds and broadcasts is bounded; each block passes over the index once.
    """
    index = build(vectors, shards)
    found, block, size = None, [], 0

    def done():
        nonlocal found, block, size
        one, block, size = _searched(index, block, k), [], 0
        found = one if found is None else found.union(one)

    for r in queries.toLocalIterator():
        block.append(r)
        size += 8 * len(r["v"]) + 64
        if size >= query_bytes:
            done()
    if block or found is None:
        done()
    return _best(found, k, "query_id").select("query_id", "rank", "vec_id", "score")
