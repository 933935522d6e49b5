"""Exact top-k by inner product: the threshold algorithm over sorted lists, one for each dimension.

Candidates lie in blocks; a block sorts each dimension once. A query reads every list
from the end that favours it (down where its weight is positive, up where it is
negative), all to the same depth, and scores each vector that it meets there whole.
No vector that it hasn't met can score more than the weights times the values at that
depth; once that bound is below the k-th score so far, the block is done. A bound that
equals the k-th score goes on, as ties fall to the smaller id.

Depths are not walked step by step: the bounds of a grid of depths cost one product, so
the query knows the depth that would stop it at the score it has. It goes there by
doubling; where that would take more reads than the block has vectors, as it does for
many equal weights, one list read to its end meets them all, and the query does that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536  # candidates of a block: what one task holds at once
FIRST = 16  # depth of the first look
_EXACT = 1 << 53


def scaled(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null for vectors that are null or hold null, NaN or infinity."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor of a double would be a long, which huge components don't fit
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    return F.when(fine, F.transform(x, lambda v: v - F.pmod(v, F.lit(1.0))))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of numbers, the shorter ones filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), int(n.max(initial=0)) if width is None else width
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out[:, :width]


class Lists:
    """A block of candidates and its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        at = np.argsort(ids, kind="stable")  # rows in order of id: the first of equal scores is the smaller id
        self.ids, self.largest = ids[at], float(np.abs(vectors).max(initial=0))
        # whole numbers: 24 bits hold sums of small ones
        self.v = vectors[at].astype(np.float32 if self.largest**2 * max(1, vectors.shape[1]) < 1 << 24 else np.float64)
        self.n, self.width = self.v.shape
        self.up = np.ascontiguousarray(np.argsort(self.v, axis=0, kind="stable").T.astype(np.int32))  # (dimension, place)
        depth, grid = FIRST, []
        while depth < self.n:
            grid.append(depth)
            depth = max(depth + 1, depth * 9 // 8)
        self.grid = np.array([*grid, self.n])
        dims = np.arange(self.width)[:, None]
        # the value at each depth of the grid, from the low and the high end: what lies deeper is no further out
        self.low = self.v[self.up[:, self.grid - 1], dims]
        self.high = self.v[self.up[:, self.n - self.grid], dims]
        self.met, self.place = np.zeros(self.n, bool), np.zeros(self.n, np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Most that a vector unmet at each depth of the grid can score."""
        return np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, accesses) of the k best candidates but those with the id own, best first, and the list entries read."""
        weigh = np.flatnonzero(q)
        if not len(weigh):  # every score is 0: the smallest ids
            rows = np.flatnonzero(self.ids != own)[:k]
            return self.ids[rows], np.zeros(len(rows), self.v.dtype), 0
        q = q.astype(self.v.dtype)
        bounds = self.bounds(q)
        down, up = weigh[q[weigh] > 0], weigh[q[weigh] < 0]
        rows, scores, depth, step, reads = np.zeros(0, np.int64), np.zeros(0, self.v.dtype), 0, 0, 0
        self.met[:] = False
        while True:
            to = int(self.grid[step])
            seen = np.concatenate([self.up[down, self.n - to : self.n - depth].ravel(), self.up[up, depth:to].ravel()])
            depth, reads = to, reads + len(seen)
            seen = seen[~self.met[seen]]
            self.met[seen] = True
            self.place[seen] = np.arange(len(seen))
            fresh = seen[self.place[seen] == np.arange(len(seen))]  # each once
            rows, scores = self._kept(rows, scores, fresh, self.v[fresh] @ q, own, k)
            if depth == self.n:
                break
            stop = len(self.grid) - 1
            if len(rows) == k:
                over = bounds >= scores[-1]  # bounds fall with depth
                if not over[step]:
                    break
                stop = stop if over.all() else int(np.argmin(over))
            if len(weigh) * (int(self.grid[stop]) - depth) > self.n:
                # as many reads would meet every vector in one list: that of the greatest weight is read to its end
                reads += self.n - depth
                left = np.flatnonzero(~self.met)
                every = self.v @ q if 2 * len(left) > self.n else None
                rows, scores = self._kept(rows, scores, left, self.v[left] @ q if every is None else every[left], own, k)
                break
            # twice as deep, but not past the depth that stops it as things are
            step = max(step + 1, min(int(np.searchsorted(self.grid, 2 * depth)), stop))
        return self.ids[rows], scores, reads

    def _kept(self, rows: np.ndarray, scores: np.ndarray, fresh: np.ndarray, more: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those kept and fresh ones, best first."""
        if len(rows) == k:
            good = more >= scores[-1]
            fresh, more = fresh[good], more[good]
        elif len(fresh) > 8 * k:
            good = more >= np.partition(more, len(more) - 4 * k)[len(more) - 4 * k] if (self.ids[fresh] == own).sum() < k else np.ones(len(fresh), bool)
            fresh, more = fresh[good], more[good]
        other = self.ids[fresh] != own
        rows, scores = np.append(rows, fresh[other]), np.append(scores, more[other])
        order = np.lexsort((rows, -scores))[:k]  # rows lie in order of id
        return rows[order], scores[order]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, query, id, vector) by block, its candidates first."""
        block, waiting, lists = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, waiting, lists = blocks[a], [], None
                if not kinds[a]:
                    waiting.append(part)
                    continue
                if not waiting and lists is None:
                    continue  # a block without candidates
                if lists is None:
                    held = pa.Table.from_batches(waiting)
                    lists, waiting = Lists(held.column(2).to_numpy(), _matrix(held.column(3))), []
                yield _answers(lists, part.column(2).to_numpy(), _matrix(part.column(3), lists.width), k)

    return run


def _answers(lists: Lists, ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    most = lists.largest * float(np.abs(queries).max(initial=0)) * max(1, lists.width)
    whole = most < _EXACT
    if lists.v.dtype == np.float32 and most >= 1 << 24:
        lists.v, lists.low, lists.high = (x.astype(np.float64) for x in (lists.v, lists.low, lists.high))
    found = []
    for own, q in zip(ids.tolist(), queries):
        if whole:  # every sum is a whole number that a double holds
            near, scores, _ = lists.best(q, own, k)
            found.append((np.full(len(near), own), near, scores.astype(np.int64)))
        else:
            exact = [sum(int(x) * int(y) for x, y in zip(v, q.tolist())) for v in lists.v.tolist()]
            order = sorted((-s, i) for s, i in zip(exact, lists.ids.tolist()) if i != own)[:k]
            found.append((np.full(len(order), own), np.array([i for _, i in order], np.int64), np.array([-s for s, _ in order], np.int64)))
    columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ()))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of most inner product for each query but those of its own id; ties go to the smaller id.

    Components are floor(scale * x). Each query meets every block of candidates once,
    where lists decide how deep it reads; k rows a query and block come back. There are
    as many blocks as candidates fill, and no fewer than cores. Nothing is broadcast.

    Rows whose vector or id is null, or whose vector holds null, NaN or infinity, take
    no part on either side. Shorter vectors count as filled up with zeros. Queries that
    share an id are one (the greatest vector); candidates that share one each have a
    rank. Fewer than k candidates give fewer rows, empty tables none. Other columns are not read.
    Scores over 2**63 raise an error."""
    spark = vectors.sparkSession
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col, scale).alias("vector")).where("id is not null and vector is not null")
    candidates, asked = rows(vectors), rows(queries).groupBy("id").agg(F.max("vector").alias("vector"))
    blocks = max(-(-vectors.count() // block), spark.sparkContext.defaultParallelism)
    dealt = candidates.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("query"), "id", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("query"), "id", "vector")
    met = dealt.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "query")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
