"""Rankings, ordered distinct, first-wins deduplication, zips, merges and other small relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.dedupe import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows: in a reliable checkpoint, or on the executors' disks where machines share no folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        try:
            sc.setCheckpointDir(shared_folder(df.sparkSession))
        except RuntimeError:
            return df.localCheckpoint(eager=True)
    return df.checkpoint(eager=True)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Catalyst turns the filter on row_number into a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by `order`: a minimum over structs, so that it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    marked = df.select(*keys, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *rest).alias("__row"))
    return marked.groupBy(*keys).agg(F.min("__row").alias("__row")).select(*keys, *(F.col("__row")[c].alias(c) for c in rest)).select(*df.columns)


def ordered_distinct(df: DataFrame, value: str, position: str, by: list[str] | None = None) -> DataFrame:
    """Each value once, with the place of its first occurrence."""
    return df.groupBy(*(by or []), value).agg(F.min(position).alias(position))


def zip_rows(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Pairs rows by an explicit place; rows without a partner stay."""
    return left.join(right, on, "full")


def pad(values: Column, size: int, blank: str = "") -> Column:
    """Cut or filled to exactly `size` elements."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(blank), size)), 1, size)


def triple(values: Column) -> Column:
    """Three slots joined by semicolons."""
    return F.array_join(pad(values, 3), ";")


def interleave(first: Column, second: Column) -> Column:
    """The triple of two padded lists: first of each, then the second of the first; repeats (blanks, too) count once."""
    a, b = pad(first, 3), pad(second, 3)
    return triple(F.array_distinct(F.array(a[0], b[0], a[1])))


def min_max(value: Column, by: list[str]) -> Column:
    """(value - min) / (max - min) within a group; null where all values are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.try_divide(value - low, high - low)


def min_max_array(values: Column) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.try_divide(v - low, high - low))


def merge_latest(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: for each key the row with the greatest `order`; incoming rows win ties. One shuffle, combined before it."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return distinct_on(both, keys, [-F.col(order).cast("double"), -F.col("__new")]).drop("__new")


def concat_minus(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `first`, then those of `second` whose keys are not in `first`."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def counts_over(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A count for each value of a fixed domain, zero where none occurs."""
    known = df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    return F.broadcast(known).join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
