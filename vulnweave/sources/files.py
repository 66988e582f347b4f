"""Files: corpora in CSV, TSV and JSON, listings and bodies of project trees."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY = "id string, name string, summary string"


def csv_corpus(spark: SparkSession, path: str, schema: str = LIBRARY, sep: str = ",") -> DataFrame:
    """Quoted fields may hold line ends and doubled quotes; rows without a name go."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=True, quote='"', escape='"').where(F.col("name").isNotNull())


def tsv_corpus(spark: SparkSession, path: str, schema: str = LIBRARY) -> DataFrame:
    return csv_corpus(spark, path, schema, "\t")


def messy_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines go, missing values become empty, the first column (an index) isn't returned."""
    df = spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED", quote='"', escape="\\")
    return df.drop(df.columns[0]).fillna("")


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array (or object) a file."""
    return spark.read.json(path, schema=schema, multiLine=True)


def literal_list(c: Column) -> Column:
    """A list of texts as Python writes it -> array<string>; null if it is none."""
    return F.when(c.rlike(r"^\s*\[.*\]\s*$"), F.from_json(F.when(c.contains('"'), c).otherwise(F.translate(c, "'", '"')), "array<string>"))


LISTING = "project string, rel_dir string, file string, ext string, depth int, seq long"


def listing(spark: SparkSession, projects: dict[str, str], skip: tuple[str, ...] = ()) -> DataFrame:
    """(project -> folder) -> project, rel_dir, file, ext, depth, seq. Spark's own readers hide names with a dot or an underscore in front, so the tree is walked here."""
    rows, seq = [], 0
    for project, root in projects.items():
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d not in skip)
            rel = os.path.relpath(folder, root)
            rel = "" if rel == "." else rel.replace(os.sep, "/")
            for file in sorted(files):
                rows.append((project, rel, file, os.path.splitext(file)[1].lower(), rel.count("/") + bool(rel), seq))
                seq += 1
    return spark.createDataFrame(rows, LISTING)


def bodies(spark: SparkSession, chosen: DataFrame, roots: dict[str, str]) -> DataFrame:
    """(project, rel_dir, file, ...) -> with path and body, read where the tasks run; unreadable files have a null body."""
    known = F.create_map(*(F.lit(x) for pair in roots.items() for x in pair))
    path = F.concat_ws("/", known[F.col("project")], F.nullif(F.col("rel_dir"), F.lit("")), F.col("file"))

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        def one(p):
            try:
                with open(p, encoding="utf-8") as f:
                    return f.read()
            except (OSError, UnicodeDecodeError):
                return None

        return paths.map(one)

    return chosen.withColumn("path", path).withColumn("body", read("path"))
