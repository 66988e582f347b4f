"""Sinks: JSON arrays, CSV, split JSON sets, white-list rows and their upsert, raw pages, response envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import merge_latest


def json_array(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (a group) with a JSON array of its records, in order. For results that are to be one document; use write_json for large ones."""
    row = F.struct(*order, F.struct(*df.columns).alias("row"))
    return df.groupBy(*(by or [])).agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_sets(df: DataFrame, path: str, key: str, test_share: float = 0.1) -> None:
    """train, valid and test as JSON by a hash of the key; valid and test are separate halves."""
    part = F.pmod(F.xxhash64(key, F.lit("sets")), F.lit(10_000)) / 10_000
    name = F.when(part < test_share, "test").when(part < 2 * test_share, "valid").otherwise("train")
    df.withColumn("set", name).write.mode("overwrite").partitionBy("set").json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw page bodies, a text file a partition."""
    pages.select("body").write.mode("overwrite").text(path)


def white_list_rows(dependencies: DataFrame, project_id: Column, run_ts: Column) -> DataFrame:
    """(name, version, language, package_manager, file_path, description) -> the columns of the white-list table."""
    return dependencies.select(project_id.alias("project_id"), "name", F.coalesce("version", F.lit("")).alias("version"), "language", "package_manager", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("description", F.lit("")).alias("description"), run_ts.alias("created_time"), F.lit(0).alias("isdelete"))


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The white list after an upsert on (project_id, name, version): the latest row of each key."""
    return merge_latest(current, incoming, ["project_id", "name", "version"], "created_time")


def envelope(code: Column, message: Column, body: Column) -> Column:
    return F.to_json(F.struct(code.alias("code"), message.alias("message"), body.alias("obj")))
