"""Queries: prompts and answers of package models, detection strategies with a stub, described dependencies, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import detect, prompts, providers
from ..sources import files
from ..streaming import dedupe
from .registry import Fixture, literal, query, table


def _prompt_sql(language: str, shots: str) -> str:
    return f"trim({literal(prompts.TASK[language])} || replace(replace(text, '\"', '\\\"'), chr(10), ' ') || {shots} || {literal(prompts.QUESTION[language])})"


_SHOT = "'. Top 2 search result is maven:a:b and maven:' || item_id || ':c. '"


@query(f"SELECT item_id, {_prompt_sql('java', _SHOT)} AS java_prompt, {_prompt_sql('c', literal('. '))} AS c_prompt FROM benchmark")
def prompt_build(spark, sf_dir):
    names = F.array(F.lit("maven:a:b"), F.concat(F.col("item_id").cast("string"), F.lit(":c")), F.lit("z:z"))
    return table(spark, sf_dir, "benchmark").select("item_id", prompts.package_prompt(F.col("text"), names, 2).alias("java_prompt"), prompts.package_prompt(F.col("text"), names, 0, "c").alias("c_prompt"))


@query("""SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN role <> '' THEN '漏洞: ' || role END, CASE WHEN text <> '' THEN '描述: ' || text END, CASE WHEN turn % 2 = 0 AND text <> '' THEN '代码: ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END END, '请提供简洁的修复建议（3-5点）：') AS prompt FROM conversations""")
def repair_prompt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.repair_prompt(F.col("role"), F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("prompt"))


_ANSWERS = Fixture("n int, answer string", [(0, 'Sure.\nThe affected package is maven:org.json:json.</s>\nThe affected package is maven:x:y'), (1, 'The affected package is "a:b"'), (2, 'The affected package is maven:c:d".'), (3, "The affected package is libcurl</s>\nThe affected package is .\nThe affected package is  zlib "), (4, "")])


@query("""SELECT n, package, packages FROM (VALUES (0, 'org.json:json', ['maven:org.json:json.', 'maven:x:y']), (1, '', ['"a:b"']), (2, 'c:d', ['maven:c:d".']), (3, '', ['libcurl', 'zlib']), (4, '', [])) AS t(n, package, packages)""")
def model_text_extract(spark, sf_dir):
    return _ANSWERS.df(spark).select("n", prompts.answer_package(F.col("answer")).alias("package"), prompts.answer_packages_c(F.col("answer")).alias("packages"))


@query("SELECT p_partkey, lower(split_part(string_split(regexp_replace('github:' || p_brand || '/' || p_name || ':1.0', '^[^:]*:?', ''), '/')[-1], ':', 1)) AS artifact FROM part")
def c_artifact(spark, sf_dir):
    label = F.concat(F.lit("github:"), "p_brand", F.lit("/"), "p_name", F.lit(":1.0"))
    return table(spark, sf_dir, "part").select("p_partkey", prompts.c_artifact(label).alias("artifact"))


_RAW = Fixture("n int, raw string", [(0, '["a", "b"]'), (1, "['a', 'b']"), (2, "plain"), (3, None), (4, "[]")])


@query("SELECT n, labels FROM (VALUES (0, ['a', 'b']), (1, ['a', 'b']), (2, ['plain']), (3, []), (4, [])) AS t(n, labels)")
def label_restore(spark, sf_dir):
    return _RAW.df(spark).select("n", prompts.parse_labels(F.col("raw")).alias("labels"))


@query("SELECT n, labels FROM (VALUES (0, ['a', 'b']), (1, ['a', 'b']), (2, NULL), (3, NULL), (4, [])) AS t(n, labels)")
def literal_lists(spark, sf_dir):
    return _RAW.df(spark).select("n", files.literal_list(F.col("raw")).alias("labels"))


_WHITE = json.dumps([{"name": "guava", "desc": "core \"libs\""}, {"name": "json", "desc": "j"}])
_TWICE = Fixture("n int, text string", [(0, _WHITE), (1, json.dumps(_WHITE))])


@query("SELECT n, name, \"desc\" FROM (VALUES (0), (1)) AS a(n) CROSS JOIN (VALUES ('guava', 'core \"libs\"'), ('json', 'j')) AS b(name, \"desc\")")
def double_json(spark, sf_dir):
    return _TWICE.df(spark).select("n", F.inline(prompts.twice_json(F.col("text"), "array<struct<name:string,desc:string>>")))


@query("SELECT p_name AS coord, ecosystem, 'library ' || p_name AS description FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (SELECT unnest(['java', 'go']) AS ecosystem)")
def describe_batches(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("coord")).distinct().withColumn("ecosystem", F.explode(F.array(F.lit("java"), F.lit("go"))))
    return providers.describe(asked, providers.StubProvider()).select("coord", "ecosystem", "description")


class _PackageStub:
    """Answers with the first candidate of the prompt."""

    def think(self, messages):
        import re

        found = re.search(r"search result is (?:maven:)?(\S+?)\. What", messages[-1]["content"])
        return f"The affected package is maven:{found[1]}" if found else "unknown"


def _strategy(name: str) -> None:
    def run(spark, sf_dir):
        vulns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vuln_id"), F.col("text").alias("description"))
        named = F.concat(F.col("source"), F.lit(":"), "lang", F.lit("-"), "doc_id")
        libs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lib_idx"), named.alias("name"), F.col("text").alias("summary"))
        white = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), named.alias("entry"), F.col("text").alias("summary"))
        return detect.detect(vulns, libs, white, name, 0.5, provider=_PackageStub(), k=16)

    query(name=f"detect_{name.replace('-', '_').lower()}")(run)


for _name in detect.STRATEGIES:
    _strategy(_name)


@query("SELECT vuln_id, '' AS triple FROM (SELECT item_id AS vuln_id FROM benchmark)")
def detect_unknown_strategy(spark, sf_dir):
    vulns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vuln_id"), F.col("text").alias("description"))
    return detect.detect(vulns, None, None, "other", 0.5)


@query("SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY user_id, event_type")
def stream_dedupe_count(spark, sf_dir):
    """Each (user, kind) once over all batches of a stream of the table's file."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "event_type")
    out = dedupe.run_available(dedupe.first_of_each(stream, ["user_id", "event_type"]), dedupe.shared_folder(spark))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedupe_watermark(spark, sf_dir):
    """Event ids are unique, so the watermarked form keeps all rows; its state stays bounded by the watermark."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "event_type", "ts")
    out = dedupe.run_available(dedupe.first_of_each(stream, ["event_id"], "ts"), dedupe.shared_folder(spark))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
