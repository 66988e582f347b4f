"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import compare
from vulnweave.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
