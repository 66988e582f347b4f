"""The best entries of a list against all pairs, and the plans of the queries that use them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_match import _near_names
from vulnweave.functions import similarity as S
from vulnweave.operators import nearest
from vulnweave.operators.relational import top_k

NAMES = [*_near_names(7, 60), "red bolt", "the red red bolt", "red widget blue", "x😀y", "é" * 300]
ENTRIES = [*_near_names(7, 60)[::2], *_near_names(8, 80), "bolt red", "red red bolt", "the", "Widget RED", "y😀x", "é" * 280 + "e", "red bolt", "red bolt"]


@pytest.mark.parametrize("block", [nearest.BLOCK, 40])
@pytest.mark.parametrize(("kind", "least"), [("lev", 0.5), ("lcs", 0.5), ("cos", 0.3), ("sco", 0.3), ("weighted", 0.4)])
def test_nearest_equals_all_pairs(spark, monkeypatch, kind, least, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    if kind in ("lcs", "weighted"):  # the columns take long for long texts and split pairs of code units
        names, entries = ([x for x in xs if len(x) < 30 and "😀" not in x] for xs in (NAMES, ENTRIES))
    else:
        names, entries = NAMES, ENTRIES
    value = lambda c: S.similarity_words(F.col(c), kind) if kind in nearest.WORDS else F.col(c)
    a = spark.createDataFrame([(x,) for x in sorted(set(names))], "name string").withColumn("value", value("name"))
    b = spark.createDataFrame(list(enumerate(entries)), "place int, entry string").withColumn("value", value("entry"))
    sim = S.weighted_similarity if kind == "weighted" else S.SIMILARITIES[kind]
    every = a.select("name").crossJoin(b.select("place", "entry")).withColumn("sim", F.round(sim(F.col("name"), F.col("entry")), 9)).where(F.col("sim") >= least)
    for last in (False, True):
        expected = top_k(every, ["name"], [F.desc("sim"), F.desc("place") if last else F.col("place")], 3)
        found = nearest.nearest(a, b, kind, least, 3, last_place=last)
        rows = lambda df: sorted((r.name, r["rank"], r.place, r.entry, round(r.sim, 6)) for r in df.collect())
        assert rows(found) == rows(expected)


def test_long_texts_and_pairs_of_code_units():
    block = nearest.Block(["y😀x", "é" * 280 + "e", "", "a" * 20_000])
    assert nearest.common_substring("é" * 300, block).tolist() == [0, 280, 0, 0]
    assert nearest.common_substring("x😀y", block).tolist() == [1, 0, 0, 0]
    assert nearest.edits("a" * 300, block, 1, 2, 2)[2:].tolist() == [600, 19_700]


@pytest.mark.parametrize("name", ["detect_tinymodel_lcs", "detect_tinymodel_lev", "detect_tinymodel_cos", "detect_llm_lcs", "whitelist_lcs"])
def test_white_list_makes_no_row_a_pair(spark, name):
    """Texts have no join with the white list, and none on shared grams: these took names x entries rows."""
    from vulnweave.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "gram" not in plan and "Generate" not in plan and "MapInArrow" in plan
