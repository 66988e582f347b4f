"""Streams of advisories or events: each id once, across batches; stop rules of a paged crawl."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir). Without one, a temporary folder serves a local session; on a cluster this raises."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vulnweave-stream-")
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def first_of_each(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows whose keys weren't seen before. With a time column the state of a key is dropped once the watermark has passed it."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there, in several batches if the source says so, and reads back what it wrote."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Crawl:
    """Stop rules over batches of pages: the target count, the most pages, pages in a row without a new id, no next page."""

    def __init__(self, target: int = 5000, max_pages: int = 2000, empty_pages: int = 5) -> None:
        self.target, self.max_pages, self.empty_pages = target, max_pages, empty_pages
        self.rows = self.pages = self.empty = 0

    def page(self, new_rows: int, has_next: bool = True) -> bool:
        """Counts a page; True if the crawl goes on."""
        self.rows, self.pages = self.rows + new_rows, self.pages + 1
        self.empty = 0 if new_rows else self.empty + 1
        return has_next and self.rows < self.target and self.pages < self.max_pages and self.empty < self.empty_pages
