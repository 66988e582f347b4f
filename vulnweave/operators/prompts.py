"""Prompts for package models, and packages from what the models answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip
from .relational import pad

#: The sentences of the package prompts, by language, and the mark of an answer.
TASK = {"java": "Below is a Java vulnerability description. Please identify the software name affected by it. Input: ", "c": "Below is a C vulnerability description. Please identify the software name affected by it. Input: "}
QUESTION = {"java": "What is affected packages? Please output in the Maven identifier format maven:group id:artifact id.", "c": "What is affected packages? Please output in the format of package name."}
ANSWER = "The affected package is"


def shots(names: Column, k: int, language: str = "java") -> Column:
    """The first k names joined by `and`, each with its ecosystem's prefix."""
    prefix = "maven:" if language == "java" else ""
    return F.array_join(F.transform(F.slice(names, 1, k), lambda n: F.when(n.startswith(prefix), n).otherwise(F.concat(F.lit(prefix), n))), " and ")


def package_prompt(description: Column, names: Column, k: int = 1, language: str = "java") -> Column:
    """The prompt; without names (k = 0) it asks by the description alone."""
    text = F.replace(F.replace(description, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    middle = [F.lit(". ")] if k == 0 else [F.lit(f". Top {k} search result is "), shots(names, k, language), F.lit(". ")]
    return F.trim(F.concat(F.lit(TASK[language]), text, *middle, F.lit(QUESTION[language])))


def prompt_row(description: Column, names: Column, labels: Column, k: int = 1, language: str = "java") -> Column:
    return F.struct(F.lit("").alias("instruction"), package_prompt(description, names, k, language).alias("input"), labels.alias("output"))


def repair_prompt(name: Column, description: Column, code: Column) -> Column:
    """Lines for what is known; code is cut after 500 characters."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    short = F.when(F.length(code) > 500, F.concat(F.substring(code, 1, 500), F.lit("..."))).otherwise(code)
    return F.concat_ws("\n", part("漏洞: ", name), part("描述: ", description), part("代码: ", short), F.lit("请提供简洁的修复建议（3-5点）："))


def clean_package(package: Column) -> Column:
    """Without blanks, dots behind, quotes and the maven: prefix."""
    return F.regexp_replace(strip(F.rtrim(strip(package), F.lit(".")), '"'), "^maven:", "")


def answer_package(answer: Column) -> Column:
    """The Maven package of the first line that holds the mark and `maven:`; empty if none does."""
    line = F.get(F.filter(F.split(answer, "\n"), lambda s: s.contains(ANSWER) & s.contains("maven:")), F.lit(0))
    return F.coalesce(clean_package(F.replace(F.regexp_extract(line, "(maven:.*)$", 1), F.lit("</s>"), F.lit(""))), F.lit(""))


def answer_packages_c(answer: Column) -> Column:
    """What follows the mark in each line, if it is something and doesn't begin with a dot."""
    told = F.transform(F.filter(F.split(answer, "\n"), lambda s: s.contains(ANSWER)), lambda s: strip(F.replace(F.substring_index(s, ANSWER, -1), F.lit("</s>"), F.lit(""))))
    return F.filter(told, lambda s: (s != "") & ~s.startswith("."))


def c_artifact(label: Column) -> Column:
    """The artifact of `ecosystem:path/name:version`, lower-case."""
    rest = F.regexp_replace(label, "^[^:]*:?", "")
    return F.lower(F.split_part(F.element_at(F.split(rest, "/"), -1), F.lit(":"), F.lit(1)))


def parse_labels(raw: Column) -> Column:
    """An array of a JSON array in text, also with single quotes; a text that is neither is one label; null gives an empty array."""
    kind = "array<string>"
    whole = lambda c: F.when(c.rlike(r"^\s*\[.*\]\s*$"), F.from_json(c, kind))
    return F.coalesce(whole(raw), whole(F.translate(raw, "'", '"')), F.when(raw.isNotNull(), F.array(raw)), F.array().cast(kind))


def trim_top_k(names: Column, size: int = 10) -> Column:
    return pad(F.coalesce(names, F.array().cast("array<string>")), size)


def twice_json(text: Column, kind: str) -> Column:
    """A value of a JSON text, which may itself be a JSON string of the JSON."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return F.from_json(F.when(strip(text).startswith('"'), inner).otherwise(text), kind)
