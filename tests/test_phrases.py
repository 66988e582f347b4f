"""Strings and passages that texts hold, against a search of each in each, and the plans of the queries that use them."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnweave.operators import phrases, rules
from vulnweave.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def _texts(seed: int, n: int, most: int) -> list[str | None]:
    r = random.Random(seed)
    words = ["a", "ab", "é", "bé", "c", "dd", "", " ", "x😀"]
    return [None if i % 17 == 3 else "".join(r.choice(words) + r.choice(["", " ", "  ", "\n", "\t"]) for _ in range(r.randint(0, most))) for i in range(n)]


def test_passages_equal_a_search_of_each():
    texts = _texts(1, 600, 40)
    r = random.Random(2)
    parts = [t[(a := r.randint(0, len(t))) : a + r.randint(0, 40)] for t in texts if t]
    passages = [*dict.fromkeys([*parts[:200], "", "a", " ab ", "zz a zz", *(t for t in _texts(3, 100, 9) if t is not None)])]
    expected = [(i, j) for i, t in enumerate(texts) if t is not None for j, p in enumerate(passages) if p in t]
    assert list(phrases.Passages(passages).held(pa.array(texts, pa.string()))) == expected


def test_passage_that_begins_within_a_word(spark):
    """The join on whole first words missed it."""
    texts = spark.createDataFrame([("t", "xyThe quick brown fox jumps over the lazy dogs!"), ("u", "The quick brown fox")], "item string, text string")
    passages = spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog"), (8, "fox")], "query_id long, passage string")
    assert sorted(map(tuple, phrases.passages_held(texts, passages).collect())) == [(7, "t"), (8, "t"), (8, "u")]


def test_strings_equal_a_search_of_each():
    texts = _texts(4, 1200, 30)
    strings = sorted({t for t in [*_texts(5, 150, 4), "a", "é", "b", "x😀", "aba"] if t})
    expected = [[j for j, s in enumerate(strings) if s in t] if t is not None else [] for t in texts]
    assert phrases.Strings(strings).held(pa.array(texts, pa.string())) == expected


def test_rules_from_held_words_equal_rules_on_texts(spark):
    """All pairs by the features on texts; the same id for two texts, and a null one."""
    vulns = spark.createDataFrame([("a", "T", "openssl 1.1 with TLS handshake, ssl"), ("a", None, "log4j logging appender 2.14"), (None, "django", "Django web orm 3.0"), ("b", "", None)], "vuln_id string, title string, description string")
    comps = spark.createDataFrame([(0, "OpenSSL", "1.1"), (1, "log4j", None), (2, "django", "3.0"), (3, "web-orm", ""), (4, "ab", "T")], "comp_id int, name string, version string")
    every = vulns.crossJoin(comps).withColumn("s", rules.similarity(F.col("name"), F.col("version"), F.col("title"), F.col("description"))).where("s.score > 0.5").selectExpr("vuln_id", "comp_id", "s.score", "s.reasoning")
    found = rules.match(comps, vulns, all_hits=True).where("match_type = 'similarity_based'").select("vuln_id", "comp_id", "similarity", "reasoning")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)


@pytest.mark.parametrize("name", ["rule_match", "recall_at_k"])
def test_texts_are_not_cut_into_rows(spark, name):
    """No row for each run of characters or words, and no text in a join's result."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "split(text" not in plan and "body" not in plan and "contains(" not in plan.lower().replace("array_contains(", "")
