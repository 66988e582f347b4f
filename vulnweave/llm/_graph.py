"""Connected components by alternating large-star and small-star rounds, with hubs dealt over several tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Each node's edges are dealt over so many tasks in the joins, since a hub may hold a large share of all edges.
WAYS = 8


#: Edges that one task takes in memory (16 MB of them); with more, rounds of joins find the same components.
IN_MEMORY = 1_000_000


def _in_memory(batches):
    """Components of the edges (a, b) by hooking to the smaller root and pointer jumping."""
    held = [pa.Table.from_batches([x]) for x in batches if x.num_rows]
    if not held:
        return
    whole = pa.concat_tables(held)
    nodes, ends = np.unique(np.concatenate([whole.column(0).to_numpy(), whole.column(1).to_numpy()]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _with_least(pairs: DataFrame) -> DataFrame:
    """(x, y) -> (x, y, m): m is the smallest of x and its neighbours. The minimum is combined before the shuffle."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("s2"))
    salted = pairs.withColumn("s1", F.pmod(F.xxhash64("y"), F.lit(WAYS)).cast("int"))
    return salted.join(least, (F.col("x") == F.col("k")) & (F.col("s1") == F.col("s2"))).select("x", "y", "m")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v): long ids, any direction, repeats allowed -> (node, root) for each node that has an edge; root is the smallest id reachable.

    Null ends and loops are left out. No edges: no rows. Up to IN_MEMORY edges, a checked size, are one task's work. Rounds are logarithmic in the diameter in practice;
    should `rounds` not be enough, it raises rather than return a wrong answer.
    """
    e = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    if e.count() <= IN_MEMORY:
        return cut(e.coalesce(1).mapInArrow(_in_memory, "node long, root long"))
    before = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        before = now
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        large = _with_least(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        small = _with_least(large)
        e = cut(small.where("y <> m").select(F.col("y").alias("a"), F.col("m").alias("b")).union(small.select("x", "m")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
