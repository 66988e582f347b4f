"""The search against all pairs, and what its plan does not do."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from vulnweave.operators import ranking, retrieval
from vulnweave.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("cells", [ranking.CELLS, 64])
def test_search_equals_all_pairs(spark, monkeypatch, fill, cells):
    """Ties, libraries without a shared term, a null text, a repeated name; with small pieces, too."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnp"]
    libs = [(i, f"x{'qrst'[i % 4]}:{i % 50}", None if i % 13 == 0 else " ".join(r.choices(words, k=i % 9))) for i in range(60)]
    asked = [(i, " ".join(r.choices(words, k=i))) for i in range(12)]
    corpus = retrieval.corpus(spark.createDataFrame(libs, "lib_idx int, name string, summary string"))
    tokens = {x.lib_idx: x.tokens for x in corpus.collect()}
    df = Counter(t for x in tokens.values() for t in set(x))
    expected = []
    for q, text in asked:
        want = Counter(text.split())
        scored = []
        for lib, own in tokens.items():
            tf = Counter(own)
            if fill or set(tf) & set(want):
                s = sum(tf[t] / (len(own) + 1) * want[t] / sum(want.values()) * math.log(len(tokens) / (df[t] + 1)) for t in want if t in tf)
                scored.append((-round(s, 9), lib))
        expected += [(q, n, lib, round(-s, 6) + 0.0) for n, (s, lib) in enumerate(sorted(scored)[:5], 1) if want]
    found = retrieval.search(corpus, spark.createDataFrame(asked, "query_id int, text string"), 5, fill=fill)
    assert sorted((x.query_id, x["rank"], x.lib_idx, round(x.score, 6)) for x in found.collect()) == sorted(expected)


@pytest.mark.parametrize("name", ["tfidf_topk", "rerank_top3_triple"])
def test_search_makes_no_row_a_pair(spark, name):
    """No join of postings with terms, and texts are not read again."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "Generate" not in plan
    assert plan.count("Join") <= (name == "rerank_top3_triple") * 2


def test_named_search_reads_texts_once(spark):
    plan = QUERIES["tfidf_topk_named_boost"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "Generate" not in plan.replace("Generate explode(named", "")
