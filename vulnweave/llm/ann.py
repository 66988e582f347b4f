"""Approximate nearest neighbours by collision-counting hashing with query-aware windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Projections of the index, the window's width at radius 1, the share of projections that have to collide.
#: A row at the radius' distance collides in 0.84 +- 0.03 of the projections, one at 0.9 of it in 0.88 +- 0.02, one at 1.25 of it in 0.74 +- 0.03.
PROJECTIONS, WIDTH, THRESHOLD = 192, 2.8, 0.795

#: The first radius as a share of the query's bound, and its growth; likewise without bounds, as a share of the rows' spread.
BOUNDED, UNBOUNDED = (0.5, 2.0), (0.6, 1.2)

#: Rows of a block of the index, queries of a chunk, and rows of the bounded sample that gives each query its bound.
BLOCK_ROWS, CHUNK_QUERIES, PILOT_ROWS = 2048, 8192, 2048


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def matrices(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, their vectors as double precision rows) for each number of dimensions."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    flat, ends = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64), array.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0] if len(ends) else ends
    sizes = np.diff(ends)
    out = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out.append((at, flat[(ends[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)))
    return out


def _count(ranks: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many projections have each row within each query's window. left, right: projections x queries, in sorted places.

    Narrow windows are walked along the sorted arrays; wide ones, which hold a good share of the block, are tested row by
    row on the rows' places in those arrays, which then takes less.
    """
    (n, m), queries = ranks.shape, left.shape[1]
    size = right - left
    if size.sum() * 8 < m * n * queries:
        counts = np.zeros(queries * n, np.int64)
        for part in np.array_split(np.arange(m), max(1, int(size.sum() >> 21))):
            own = size[part].ravel()
            at = np.repeat(left[part].ravel() - np.cumsum(np.r_[0, own[:-1]]), own) + np.arange(own.sum())
            row = order[at, np.repeat(np.repeat(part, queries), own)]
            counts += np.bincount(np.repeat(np.tile(np.arange(queries) * n, len(part)), own) + row, minlength=queries * n)
        return counts.reshape(queries, n)
    counts = np.zeros((queries, n), np.int16)
    low, span = left.astype(np.uint16), size.astype(np.uint16)
    for j in range(m):
        counts += ranks[:, j][None] - low[j][:, None] < span[j][:, None]
    return counts


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k nearest rows that the hashing finds for each query: (places of queries, places of rows, distances, pairs whose distance was computed).

    Each projection keeps its values sorted. Windows centred on the query grow with the radius (virtual rehashing) until k
    rows verified lie within the radius, the radius has come to the query's bound, or the windows cover the block. Only a
    row that collides in THRESHOLD of the projections is verified by its distance. Blocks have 65,535 rows at most.
    """
    n, m = len(x), PROJECTIONS
    most, k = k, k + len(ids) - len(np.unique(ids))  # an id that repeats must not push others out
    axes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], m))
    px, pq = x @ axes, q @ axes
    order = np.argsort(px, axis=0, kind="stable")
    held = np.take_along_axis(px, order, axis=0)
    ranks = np.empty((n, m), np.uint16, order="F")
    np.put_along_axis(ranks, order, np.arange(n, dtype=np.uint16)[:, None], axis=0)
    spread = float(np.sqrt(2 * x.var(axis=0).sum()) + 1e-12)
    last = np.full(len(q), np.inf) if bounds is None else np.maximum(bounds, 1e-12)
    share, growth = UNBOUNDED if bounds is None else BOUNDED
    out, computed = ([], [], []), 0
    for part in np.array_split(np.arange(len(q)), -(-len(q) // 64)):
        verified = np.full((len(part), n), np.inf)
        fresh = query_ids[part][:, None] != ids[None]
        active, radius = np.arange(len(part)), share * np.minimum(last[part], spread)
        while len(active):
            reach = WIDTH / 2 * radius[active]
            left = np.stack([np.searchsorted(held[:, j], pq[part[active], j] - reach, "left") for j in range(m)])
            right = np.stack([np.searchsorted(held[:, j], pq[part[active], j] + reach, "right") for j in range(m)])
            a, b = np.nonzero((_count(ranks, order, left, right) >= THRESHOLD * m) & fresh[active])
            a = active[a]
            fresh[a, b] = False
            for at in range(0, len(a), 100_000):
                own = slice(at, at + 100_000)
                verified[a[own], b[own]] = np.sqrt(((x[b[own]] - q[part[a[own]]]) ** 2).sum(axis=1))
            computed += len(a)
            enough = np.partition(verified[active], k - 1, axis=1)[:, k - 1] <= radius[active] if n >= k else np.zeros(len(active), bool)
            active = active[~(enough | (right - left == n).all(axis=0) | (radius[active] >= last[part[active]]))]
            radius[active] = np.minimum(radius[active] * growth, last[part[active]])
        bound = np.partition(verified, k - 1, axis=1)[:, k - 1 : k] if n >= k else np.full((len(part), 1), np.inf)
        a, b = np.nonzero((verified <= bound) & np.isfinite(verified))
        out[0].append(part[a]), out[1].append(b), out[2].append(verified[a, b])
    fq, fx, fd = (np.concatenate(o) if o else np.zeros(0, int) for o in out)
    if k > most:
        order = np.lexsort((fd, ids[fx], fq))
        order = order[np.r_[True, (np.diff(fq[order]) != 0) | (np.diff(ids[fx][order]) != 0)]] if len(order) else order
        fq, fx, fd = fq[order], fx[order], fd[order]
    rank = np.lexsort((ids[fx], fd, fq))
    fq, fx, fd = fq[rank], fx[rank], fd[rank]
    keep = np.arange(len(fq)) - np.searchsorted(fq, fq, "left") < most
    return fq[keep], fx[keep], fd[keep], computed


def _bounded(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """asked with `bound`: the distance of the k-th nearest of PILOT_ROWS sampled rows. The k nearest of all rows are no farther."""
    pilot = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(PILOT_ROWS).toArrow()
    ids = pilot.column("vec_id").to_numpy()
    by = {x.shape[1]: (ids[at], x) for at, x in matrices(pilot.column("embedding"))}

    def bound(batches):
        for batch in batches:
            own, out = batch.column("vec_id").to_numpy(), np.full(batch.num_rows, np.inf)
            for at, q in matrices(batch.column("embedding")):
                if q.shape[1] in by:
                    sample, x = by[q.shape[1]]
                    fq, fx, fd, _ = search_block(sample, x, own[at], q, k)
                    full = np.flatnonzero(np.bincount(fq, minlength=len(q)) >= k)
                    out[at[full]] = [fd[fq == i].max() for i in full]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "bound"])

    kind = asked.schema["embedding"].dataType.simpleString()
    return asked.mapInArrow(bound, f"vec_id long, embedding {kind}, bound double")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows (vec_id, embedding) found for each query, by Euclidean distance.

    A bounded sample of PILOT_ROWS rows gives each query a bound on the distance of its k-th neighbour. All rows are dealt over
    blocks by a hash of their ids, each with its own sorted projections; queries go to every block, in chunks, with their
    bounds, and what the blocks find is merged. So only the sample is sent to all tasks, and work and memory of a task are
    bounded by the sizes of a block and a chunk. A query and a row are compared if their numbers of dimensions are equal.

    Unusable vectors (null, zero, null or non-finite components) and null ids take no part, as queries or rows. Rows that
    repeat an id count as one row, at the nearest of them; a repeated query counts once (its least vector). Ties: the
    smaller vec_id. Fewer than k candidates: all of them. Empty table: no rows. Other columns are ignored.
    """
    fine = lambda df: df.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = fine(vectors)
    asked = (fine(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    asked = cut(_bounded(asked, rows, k))
    blocks = max(1, -(-rows.count() // block_rows))
    chunks = max(1, -(-asked.count() // CHUNK_QUERIES))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "embedding")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), "vec_id", "embedding", "bound")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [], [], []
        if left.num_rows and right.num_rows:
            ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            bounds = right.column("bound").to_numpy()
            asked_by = {q.shape[1]: (at, q) for at, q in matrices(right.column("embedding"))}
            for at, x in matrices(left.column("embedding")):
                if x.shape[1] in asked_by:
                    q_at, q = asked_by[x.shape[1]]
                    fq, fx, fd, _ = search_block(ids[at], x, query_ids[q_at], q, k, bounds[q_at])
                    found[0].append(query_ids[q_at][fq]), found[1].append(ids[at][fx]), found[2].append(fd)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, kinds, strict=True)], ["query_id", "vec_id", "score"])

    found = dealt.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
