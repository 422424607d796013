"""Exact top-k by inner product, block at a time.

Vectors are dealt to shards of bounded size. A shard orders its vectors by their strongest
component and cuts them into blocks; a block keeps, for each component, its largest and smallest
value and, as forward index, its vectors. For a query, the products with these extremes sum to a
bound that no score in the block exceeds. Blocks are visited by falling bound and scored whole,
until the bound falls below the k-th best score so far. The shards' best rows are merged.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id; an empty vector scores 0; shorter vectors count as padded with zeros; ties go to
the smaller id; rows repeated whole count once, rows with the query's own id are no candidates;
fewer than k candidates give fewer rows; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SHARD_VECTORS = 16_384
BLOCK_VECTORS = 128
QUERY_ROWS = 256


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where any component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Shard:
    """The block index of one shard. Scores are whole numbers: products are summed as doubles
    while they stay below 2**53, else as Python integers."""

    def __init__(self, ids: list[int], vectors: list[list[int]], block: int):
        self.width = max(map(len, vectors), default=0)
        m, ids = _matrix(vectors, self.width), np.array(ids, np.int64)
        if self.width:
            lead = np.abs(m).argmax(1)
            order = np.lexsort((ids, m[np.arange(len(m)), lead], lead))
        else:
            order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.plain = ids[order], m[order], [vectors[o] for o in order]
        self.size = float(np.abs(m).max(initial=0))
        cuts = np.arange(0, len(m), block)
        self.cuts = np.append(cuts, len(m))
        self.high = np.maximum.reduceat(self.vectors, cuts) if len(m) and self.width else np.zeros((len(cuts), self.width))
        self.low = np.minimum.reduceat(self.vectors, cuts) if len(m) and self.width else np.zeros((len(cuts), self.width))

    def top(self, query_ids: list[int], queries: list[list[int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        width = max(self.width, max(map(len, queries), default=0))
        q = _matrix(queries, width)[:, : self.width]
        if self.size * float(np.abs(q).max(initial=0)) * max(1, self.width) >= 2.0**52:
            yield from self._exact(query_ids, queries, k)
            return
        bounds = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        ranked = np.argsort(-bounds, axis=1, kind="stable")
        n_blocks = bounds.shape[1]
        best_s = np.full((len(q), k), -np.inf)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        own = np.array(query_ids, np.int64)
        active = np.arange(len(q))
        for step in range(n_blocks):
            at = ranked[active, step]
            # A block whose bound equals the k-th score may still hold a tie with a smaller id.
            active = active[bounds[active, at] >= best_s[active, -1]]
            if not len(active):
                break
            at = ranked[active, step]
            for b in np.unique(at):
                rows = active[at == b]
                ids = self.ids[self.cuts[b] : self.cuts[b + 1]]
                s = q[rows] @ self.vectors[self.cuts[b] : self.cuts[b + 1]].T
                s[ids[None, :] == own[rows, None]] = -np.inf
                s = np.concatenate([best_s[rows], s], axis=1)
                i = np.concatenate([best_i[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
                if s.shape[1] > 2 * k:  # ties at the k-th score stay in
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    i = np.where(s >= least, i, np.iinfo(np.int64).max)
                    s = np.where(s >= least, s, -np.inf)
                o = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[rows] = np.take_along_axis(s, o, 1)
                best_i[rows] = np.take_along_axis(i, o, 1)
        for r, query in enumerate(query_ids):
            found = best_s[r] > -np.inf
            yield query, best_i[r][found], best_s[r][found].astype(np.int64)

    def _exact(self, query_ids: list[int], queries: list[list[int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For components so large that doubles would round; scores saturate at 64 bits."""
        most = 2**63 - 1
        for query, row in zip(query_ids, queries):
            scored = ((max(-most, min(most, sum(a * b for a, b in zip(row, v)))), int(i)) for i, v in zip(self.ids, self.plain) if i != query)
            best = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
            yield query, np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_vectors: int = SHARD_VECTORS, block: int = BLOCK_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score) for (query_id, vector) against (vec_id, vector), both with
    whole components. Every shard sees every query in turn: the sorted stream of a shard brings
    its vectors first, then queries in small groups, so a task holds one shard at a time."""
    vectors = vectors.select("vec_id", "vector").dropna().distinct()
    queries = queries.select("query_id", "vector").dropna().distinct()
    shards = max(1, -(-vectors.count() // shard_vectors))
    kept = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("part"), F.col("vec_id").alias("id"), "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"), F.col("query_id").alias("id"), "vector")
    stream = kept.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "part", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(index: Shard, ids: list[int], rows: list) -> pa.RecordBatch:
            out = [(np.full(len(i), q), i, s) for q, i, s in index.top(ids, rows, k)]
            cols = [np.concatenate([o[c] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for c in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

        now, index, ids, rows, asking = None, None, [], [], False
        for batch in batches:
            for shard, part, i, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "id", "vector"))):
                if shard != now or part != asking:
                    if now is not None and not asking:
                        index = Shard(ids, rows, block)
                    elif now is not None and ids:
                        yield found(index, ids, rows)
                    if shard != now and part == 1:  # a shard without vectors
                        index = Shard([], [], block)
                    now, asking, ids, rows = shard, part, [], []
                ids.append(i)
                rows.append(v)
                if asking and len(ids) >= QUERY_ROWS:
                    yield found(index, ids, rows)
                    ids, rows = [], []
        if asking and ids:
            yield found(index, ids, rows)

    near = stream.mapInArrow(search, "query_id long, vec_id long, score long")
    # At most k rows of a query and shard arrive; each task cuts its own to k before the exchange.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
