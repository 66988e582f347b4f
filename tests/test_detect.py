"""The registered detection strategies use the whole white list."""

from __future__ import annotations

from vulnweave.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def results(spark, name: str) -> dict:
    return {r.vuln_id: r.triple for r in QUERIES[name](spark, SF).collect()}


def test_white_list_is_the_whole_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    white = [f"{r.source}:{r.lang}-{r.doc_id}" for r in docs if r.source is not None and r.lang is not None]
    plain = results(spark, "detect_tinymodel")
    assert results(spark, "detect_tinymodel_whitelist") == plain

    def best(name: str) -> list[str]:
        sims = [(-round(1 - distance(name, w) / max(len(name), len(w)), 9), i) for i, w in enumerate(white)] if name else []
        return [white[i] for s, i in sorted(sims)[:3] if -s >= 0.5]

    expected = {}
    for vuln, triple in plain.items():
        a, b = (best(n) for n in triple.split(";")[:2])
        slots = [x[k] if k < len(x) else "" for x, k in ((a, 0), (b, 0), (a, 1))]
        expected[vuln] = ";".join([*dict.fromkeys(slots), "", "", ""][:3])
    assert results(spark, "detect_tinymodel_lev") == expected
