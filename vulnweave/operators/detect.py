"""Detection strategies: libraries that an advisory text speaks of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import match, prompts, retrieval
from .providers import answer

#: The names of the strategies.
STRATEGIES = tuple(f"{base}{end}" for base in ("TinyModel", "LLM") for end in ("", "-lev", "-cos", "-lcs", "-whiteList"))

Scorer = Callable[[DataFrame], DataFrame]


def tfidf_scorer(candidates: DataFrame) -> DataFrame:
    """The stand-in for a hosted reranker: the retrieval score itself."""
    return candidates


def detect(vulnerabilities: DataFrame, libraries: DataFrame, white_list: DataFrame, strategy: str, least: float, *, scorer: Scorer = tfidf_scorer, provider=None, language: str = "java", k: int = 512, candidates: int = 10, on_raw: bool = False) -> DataFrame:
    """(vuln_id, description) -> vuln_id, triple: up to three library names joined by semicolons.

    libraries (lib_idx, name, summary); white_list (pos, entry, summary). TinyModel ranks by the scorer, LLM asks a provider
    with the best candidates in the prompt; the endings compare the result with the white list by a similarity, or search the
    white list in place of the libraries. All advisories are one plan. An unknown strategy gives empty results.
    """
    if strategy not in STRATEGIES:
        return vulnerabilities.select("vuln_id", F.lit("").alias("triple"))
    if language not in prompts.TASK:
        raise ValueError(f"no corpus for language {language}")
    base, _, end = strategy.partition("-")
    if end == "whiteList":
        libraries = white_list.select(F.col("pos").alias("lib_idx"), F.col("entry").alias("name"), "summary")
    corpus = retrieval.corpus(libraries)
    queries = vulnerabilities.select(F.col("vuln_id").alias("query_id"), F.col("description").alias("text"))
    found = scorer(retrieval.search(corpus, queries, k).where(F.col("rank") <= candidates))
    ranked = found.select(F.col("query_id").alias("id"), F.col("rank").alias("place"), F.col("object").alias("name"), "score")
    if base == "TinyModel":
        triples = match.rerank(ranked, least, on_raw=on_raw)
    else:
        if provider is None:
            raise ValueError("this strategy needs a provider")
        names = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "place", "name"))), lambda x: x["name"]).alias("names"))
        asked = queries.join(names, F.col("query_id") == F.col("id"), "left").select(F.col("query_id").alias("id"), prompts.package_prompt(F.coalesce("text", F.lit("")), prompts.trim_top_k(F.col("names")), 1, language).alias("input"))
        told = answer(asked, provider)
        label = prompts.answer_package(F.col("answer")) if language == "java" else F.coalesce(F.get(prompts.answer_packages_c(F.col("answer")), F.lit(0)), F.lit(""))
        triples = match.label_match(told.select("id", label.alias("label")), libraries.select("name"), max(least, 1e-6))
    if end in ("lev", "cos", "lcs"):
        slots = triples.select("id", F.posexplode(F.split("triple", ";")).alias("p", "name")).select("id", (F.col("p") + 1).alias("place"), F.nullif("name", F.lit("")).alias("name"))
        triples = match.white_list_match(slots, white_list.select("pos", "entry"), end, least)
    return vulnerabilities.select("vuln_id").join(triples.withColumnRenamed("id", "vuln_id"), "vuln_id", "left").select("vuln_id", F.coalesce("triple", F.lit(";;")).alias("triple"))
