"""Every query of the catalogue against its DuckDB text."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from mound.plans import oracles
from mound.plans.catalog import QUERIES
from tests.conftest import SF
from tests.oracle_check import connect, differences

ORACLES = oracles.build()
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_models_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", ["m9_recalibrate"])
def test_scores_are_probabilities(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() == 492
    assert out.filter("score is null or not score between 0 and 1").count() == 0


def test_entry(spark):
    assert entry(spark).count() == 6000
