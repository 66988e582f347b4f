"""Fuzzy joins and the rule matcher against all pairs, and their plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vulnweave.functions import similarity as S
from vulnweave.operators import match, rules
from vulnweave.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def _near_names(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    bases = ["".join(r.choices("abcdeilnorst-", k=r.randint(1, 18))) for _ in range(n // 4)] + ["", "a", "ab"]
    out = []
    for b in bases:
        for _ in range(4):
            t = list(b)
            for _ in range(r.randint(0, 4)):
                at = r.randint(0, len(t))
                t[at : at + r.randint(0, 1)] = r.choices("abcxyzé", k=r.randint(0, 1))
            out.append("".join(t))
    return out


@pytest.mark.parametrize(("kind", "least"), [("lev", 0.3), ("lev", 0.5), ("lev", 0.8), ("lcs", 0.2), ("lcs", 0.5), ("lcs", 0.9), ("lev", 1.0)])
def test_string_joins_lose_no_pair(spark, kind, least):
    names = spark.createDataFrame([(x,) for x in _near_names(1, 80)], "name string")
    white = spark.createDataFrame(list(enumerate(_near_names(2, 40) + _near_names(1, 40))), "pos int, entry string")
    every = names.distinct().crossJoin(white).withColumn("sim", F.round(S.SIMILARITIES[kind](F.col("name"), F.col("entry")), 9)).where(F.col("sim") >= least)
    found = match.fuzzy_pairs(names, white, kind, least)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    rows = lambda df: sorted((r.name, r.pos, r.sim) for r in df.collect())
    assert rows(found) == rows(every)


def test_labels_find_every_close_artifact(spark):
    labels = spark.createDataFrame([(i, f"g:{x}") for i, x in enumerate(_near_names(3, 40)) if x], "id int, label string")
    libraries = spark.createDataFrame([(f"g:{x}",) for x in _near_names(3, 40)[1::2] + _near_names(4, 20) if x], "name string")
    out = {r.id: r.triple for r in match.label_match(labels, libraries, 0.5).collect()}
    names = [r.name for r in libraries.distinct().collect()]
    pairs = labels.crossJoin(libraries.distinct()).withColumn("sim", F.round(S.weighted_similarity(F.substring_index("label", ":", -1), F.substring_index("name", ":", -1)), 9)).where("sim >= 0.5").select("id").distinct()
    near = {r.id for r in pairs.collect()}
    assert names and {i for i, t in out.items() if t != ";;"} == near


@pytest.mark.parametrize("size", [-1, 10 << 20])
def test_rule_matcher_has_no_product(spark, size):
    """With small sides sent out and without."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size))
    try:
        out = QUERIES["rule_match"](spark, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert out.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mentions_of_whole_texts(spark):
    got = {r.doc_id: r for r in QUERIES["entity_mentions"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.text is not None:
            own = re.compile(rules.PATTERNS["python_package"])
            assert got[r.doc_id].n == len(own.findall(r.text))
