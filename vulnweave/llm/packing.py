"""Best-fit decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, map_arrow, partitions
from .tokenize import encode_text


class _Capacities:
    """A segment tree over remaining capacities 0..top: how many bins have each, and the tightest one that fits, in logarithmic time."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that a bin has."""
        at = self.size + least
        if self.count[at]:
            return least
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at + (not self.count[2 * at])
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over lengths 1..capacity, whose counts are given.

    Documents of one length are alike, so a step places a run of them: after the first has gone to the tightest bin of
    remaining capacity r, that bin is the tightest for the next as long as it fits, then the next bin of r. The result is
    what placing them one by one gives. A step is (length, first rank, bins, first bin, documents a bin, offset): document
    j of the run has bin `first bin + j // documents a bin` and place `offset + j % documents a bin * length`. Each length
    splits at most two runs of bins, so steps depend on the capacity and not on the number of documents.
    """
    tree, held, steps, opened = _Capacities(capacity), [deque() for _ in range(capacity + 1)], [], 0
    for length in range(capacity, 0, -1):
        left, rank = histogram.get(length, 0), 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, opened, -(-left // (capacity // length))
                opened += bins
            else:
                first, bins = held[room].popleft()
                tree.add(room, -bins)
            each = room // length
            used, each = (min(bins, left // each), each) if left >= each else (1, left)
            steps.append((length, rank, used, first, each, capacity - room))
            for at, start, n in ((room - each * length, first, used), (room, first + used, bins - used)):
                if n and at:
                    held[at].append((start, n)) if at != room else held[at].appendleft((start, n))
                    tree.add(at, n)
            rank += used * each
            left -= used * each
    return steps


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each document plus end_id; those over `capacity` are cut into pieces of it, the first one shorter where need be."""

    def rows(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode_text(text or "", tokenizer), end_id], "<u4")
                head = len(ids) % capacity or capacity
                for n, start in enumerate([0, *range(head, len(ids), capacity)]):
                    own = ids[start : start + (capacity if n else head)]
                    out.append((doc, n, start, len(own), zlib.crc32(own.tobytes())))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut_up: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """Gives each piece (doc_id, piece, length, ...) a sequence_id and its offset there, by best-fit decreasing over all pieces.

    The driver sees `capacity` counts; the steps that go to the tasks are bounded by the capacity too. Ranks within a length
    come from counts of hashed slots, so a length that many pieces share is dealt over all tasks.
    """
    held = cut(cut_up)
    slots = 4 * partitions(held)
    held = held.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    counts = cut(held.groupBy("slot", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    steps = np.array(best_fit_plan(histogram, capacity), np.int64).reshape(-1, 6)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    span = max(histogram.values(), default=0) + 1
    keys = steps[:, 0] * span + steps[:, 1]
    before = counts.select("slot", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = held.withColumn("own", F.row_number().over(Window.partitionBy("slot", "length").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["slot", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            step = steps[np.searchsorted(keys, length * span + rank, "right") - 1]
            j = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(step[:, 3] + j // step[:, 4]), pa.array(step[:, 5] + j % step[:, 4] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    held.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated rows: packed each. Ties between
    equal lengths: any order. Empty table: no rows. Other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity=capacity, end_id=end_id), capacity=capacity)
