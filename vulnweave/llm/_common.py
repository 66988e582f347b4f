"""Helpers shared by the operators: table access, lineage cuts, grouped Arrow streaming, salted joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch to a Python worker: the same for all operators, so plans that run later are not changed.
BATCH_BYTES = 16 << 20

#: Rows and bytes of text that a function of map_arrow sees at a time. A longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, since texts may be very long. Every operator sets the same value."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one, a temporary folder serves a local session; on a cluster, whose machines don't share it, this raises."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="vulnweave-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and cuts its lineage with a reliable checkpoint.

    Spark deletes the files when the frame is no longer held, where spark.cleaner.referenceTracking.cleanCheckpoints says so.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return name if name not in taken else f"{name}_{uuid.uuid4().hex}"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `rows` rows and, beyond single rows, `most` bytes."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def give_back() -> None:
    """Returns free memory of this worker to the system: idle workers are kept by the executor, beside its next tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a partition, after which the worker's free memory goes back."""

    def run(batches):
        yield from fn(batches)
        give_back()

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for long texts: the function gets them in slices."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(lean(lambda batches: fn(piece for batch in batches for piece in slices(batch))), schema)


def key_chunks(batches: Iterable[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Joins the batches of a partition sorted by key into tables of about `rows` rows that never split a key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield whole.slice(0, last)
            held, count = whole.slice(last).to_batches(), whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return edges, np.r_[edges[1:], len(keys)] if len(keys) else edges


#: Hot keys that are sent out at most: 1024 numbers, whatever the size of the data. A key outside them has at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1024


def hot_keys(counted: DataFrame, key: str, count: str, least: int = 256) -> list[int]:
    """The HOT_KEYS keys with most rows, of those with over `least` rows; there are no others with more than 1/HOT_KEYS of all rows."""
    return [r[0] for r in counted.where((F.col(count) > least) & F.col(key).isNotNull()).orderBy(F.desc(count), key).select(key).limit(HOT_KEYS).collect()]


def salt_many(hot: list[int], key: str, spread: Column, ways: int) -> Column:
    """The salt of a row on the side that has many rows a key: only hot keys are dealt over several tasks."""
    return F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(ways))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0)


def salt_one(hot: list[int], key: str, ways: int) -> Column:
    """The salts that a row of the other side takes; to be exploded."""
    once = F.array(F.lit(0))
    return F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(once) if hot else once


class Forest:
    """Union-find over the values that it meets; the smallest value of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = min(a, b), max(a, b)
            self.up[high] = low
            self.up.setdefault(low, low)

    def edges(self) -> tuple[list[int], list[int]]:
        """One edge for every value that isn't a root: it and its root."""
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]
