"""Sources, sinks, providers and stop rules, on files of their own; the rest of the engine without the training-data folders."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vulnweave.operators import manifest, providers
from vulnweave.sources import files, pages, sinks
from vulnweave.streaming.dedupe import Crawl

ROOT = Path(__file__).resolve().parent.parent


def test_csv_and_json(spark, tmp_path):
    rows = [("1", "a:b", 'two\nlines, "quoted"'), ("2", "c", None)]
    sinks.write_csv(spark.createDataFrame(rows, files.LIBRARY), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in files.csv_corpus(spark, str(tmp_path / "csv")).collect()) == rows
    sinks.write_json(spark.createDataFrame(rows, files.LIBRARY), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "t.tsv").write_text("id\tname\tsummary\n1\tx\ty\n2\t\tz\n")
    assert [r.name for r in files.tsv_corpus(spark, str(tmp_path / "t.tsv")).collect()] == ["x"]
    sinks.write_sets(spark.range(500), str(tmp_path / "sets"), "id")
    sets = {r["set"]: r["n"] for r in spark.read.json(str(tmp_path / "sets")).groupBy("set").agg(F.count("*").alias("n")).collect()}
    assert sum(sets.values()) == 500 and set(sets) == {"train", "valid", "test"}


def test_pages_source(spark, tmp_path):
    pages.register(spark)
    for n in (1, 2):
        (tmp_path / f"p{n}.html").write_text(f"page {n}")
    url = f"file://{tmp_path}/p{{page}}.html"
    got = spark.read.format("advisory_pages").option("url", url).option("first", 1).option("last", 3).option("attempts", 1).load().orderBy("page").collect()
    assert [(r.page, r.body) for r in got] == [(1, "page 1"), (2, "page 2"), (3, None)]
    assert got[2].error
    assert pages.landed(spark, str(tmp_path)).count() == 2


def test_projects_from_disk(spark, tmp_path):
    (tmp_path / "sub" / ".hidden").mkdir(parents=True)
    (tmp_path / "requirements.txt").write_text("a==1\n")
    (tmp_path / "poetry.lock").write_text('[[package]]\nname = "b"\nversion = "2"\n')
    (tmp_path / "sub" / ".hidden" / "go.mod").write_text("require x.y/z v1.0.0\n")
    listing = files.listing(spark, {"p": str(tmp_path)})
    assert listing.count() == 3
    found = manifest.extract(files.bodies(spark, manifest.discover(listing), {"p": str(tmp_path)}))
    assert sorted(r.coord for r in found.collect()) == ["b 2", "x.y/z v1.0.0"]


def test_crawl_stops():
    crawl = Crawl(target=100, max_pages=50, empty_pages=2)
    assert crawl.page(10) and crawl.page(0) and crawl.page(3) and crawl.page(0) and not crawl.page(0)
    assert not Crawl(target=5).page(9) and not Crawl(max_pages=1).page(1) and not Crawl().page(1, has_next=False)


def test_retry():
    waits, left = [], [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "ok"

    assert providers.retry(call, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        left[0] = 9
        providers.retry(call, sleep=waits.append)


def test_strict_forms(spark):
    body = "requests==2.31.0\n-r x.txt\nuvicorn[standard]>=0.2\na==1.0rc1\n"
    df = spark.createDataFrame([(body,)], "body string")
    both = df.select(manifest.requirements(F.col("body"), True).alias("s"), manifest.requirements(F.col("body")).alias("d")).first()
    assert [tuple(x) for x in both.s] == [("requests", "2.31.0"), ("-r", None), ("uvicorn", None), ("a", "1.0")]
    assert [tuple(x) for x in both.d] == [("requests", "2.31.0"), ("uvicorn", "0.2"), ("a", "1.0rc1")]


def test_engine_stands_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "vulnweave", tmp_path / "vulnweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tfidf_topk' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
