"""SimHash fingerprints of word shingles and near-duplicate groups by pigeonring filtering."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from ._common import Forest, cut, hot_keys, key_chunks, map_arrow, partitions, runs, salt_many, salt_one
from ._graph import connected_components

#: Segments of a fingerprint, their bits, and the largest number of differing bits of a link. Budgets below follow from these.
SEGMENTS, BITS, DISTANCE = 4, 16, 3

#: Fingerprints of one bucket that a task compares at a time; larger buckets, whatever the size of the data, are dealt over cells of pairs of such parts.
CELL = 512


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; bit 63 is the first of the 16 hex digits."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - width + 1)
    hashes = np.frombuffer(b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[:n], starts[-n:], strict=True)]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_280):
        bits = np.unpackbits(hashes[at : at + 65_280], axis=1)
        whole = len(bits) // 255 * 255
        votes += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row; words are runs of bytes other than ASCII white space, A-Z lower-cased."""

    def rows(batches):
        for batch in batches:
            own = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), rows, "doc_id long, fp long")


def _mask(first: int, count: int) -> int:
    """The bits of `count` consecutive segments of the ring from segment `first`."""
    return sum(0xFFFF << (BITS * ((first + i) % SEGMENTS)) for i in range(count))


def link_edges(prints: DataFrame) -> DataFrame:
    """fp (distinct) -> (u, v): a spanning forest of the graph of fingerprints with DISTANCE or fewer differing bits.

    Pigeonring: of m = 4 segments in a ring with 3 differing bits in all, some segment i starts a chain whose first l
    segments differ in at most l*3/4 bits together, for every l: none in i, at most 1 by i+1, at most 2 by i+2. So segment i
    is equal, and of the two halves of i+1 one is equal too: a bucket is (i, half, segment i, that half), 24 bits, eight rows
    a fingerprint. The rest of the chain is tested before the whole distance. Buckets with many fingerprints are dealt over
    cells (part, part), so that no task and no row holds a whole bucket; a task gives back a forest and not the pairs.
    """
    segment = lambda i: F.shiftrightunsigned("fp", BITS * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))
    half = lambda i, h: F.shiftrightunsigned("fp", BITS * (i % SEGMENTS) + 8 * h).bitwiseAND(F.lit(0xFF))
    keys = [F.lit((2 * i + h) << 24).bitwiseOR(F.shiftleft(segment(i), 8)).bitwiseOR(half(i + 1, h)).cast("long") for i in range(SEGMENTS) for h in (0, 1)]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = shared.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.join(shared, "key").withColumn("part", part).withColumn("other", other)
    cells = dealt.select("key", "fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))

    def compare(batches):
        forest = Forest()
        budgets = [[np.uint64(_mask((i + 1) % SEGMENTS, k)) for k in range(1, SEGMENTS)] for i in range(SEGMENTS)]
        for chunk in key_chunks(batches, "cell"):
            cell, key, fp = (chunk.column(c).to_numpy() for c in ("cell", "key", "fp"))
            start, end = runs(cell)
            many = np.repeat(end - start, end - start) > 1
            cell, key, value = cell[many], key[many], fp[many].view(np.uint64)
            first, ring = np.arange(len(cell)), (key >> 25).astype(np.int64)
            masks = np.array(budgets, np.uint64)
            for step in range(1, len(cell)):
                first = first[first + step < len(cell)]
                first = first[(cell[first] == cell[first + step])]
                if not len(first):
                    break
                at = first[key[first] == key[first + step]]
                differ = value[at] ^ value[at + step]
                for k in range(SEGMENTS - 1):
                    keep = np.bitwise_count(differ & masks[ring[at], k]) <= (k + 2) * DISTANCE // SEGMENTS
                    at, differ = at[keep], differ[keep]
                keep = (np.bitwise_count(differ) <= DISTANCE) & (differ > 0)
                for a, b in zip(value[at[keep]].view(np.int64).tolist(), value[at[keep] + step].view(np.int64).tolist(), strict=True):
                    forest.join(a, b)
        u, v = forest.edges()
        for a in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 50_000], pa.int64()), pa.array(v[a : a + 50_000], pa.int64())], ["u", "v"])

    return cells.repartition(partitions(prints), "cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *, width: int = 3, ways: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of 3 or fewer differing bits.

    Null, empty or blank text: fingerprint zero, linked like any other. Null doc_id: kept, with its component's smallest
    non-null id (null if there is none). Repeated rows: one result each. Empty table: no rows. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, width=width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(link_edges(distinct.select("fp")))
    of_root = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    least = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    hot = hot_keys(distinct, "fp", "n")
    grouped = of_root.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    hot_roots = hot_keys(grouped, "root", "n")
    known = of_root.withColumn("salt", salt_many(hot_roots, "root", F.col("fp"), ways)).join(least.withColumn("salt", F.explode(salt_one(hot_roots, "root", ways))), ["root", "salt"]).select("fp", "component_id")
    known = known.withColumn("salt", F.explode(salt_one(hot, "fp", ways)))
    return prints.withColumn("salt", salt_many(hot, "fp", F.col("doc_id"), ways)).join(known, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id, with all its columns.

    Near duplicates have a Jaccard similarity of `least` or more of their `width`-word shingles, or link with such a text. That
    takes a SimHash of more than 64 bits: see `shingles`, which also says what happens to odd rows.
    """
    return shingles.keep_one(docs, width=width, least=least)
