"""Every registered query against its DuckDB oracle (what the driver's verify does)."""

import pytest

from tables import SF_SMALL
from compare import compare

import __spark_entry__ as E
from loanroll.plans.oracle_sql import oracle_sql
from loanroll.plans.registry import queries

KEYS = sorted(queries())  # the optional operators have tests of their own


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, KEYS)


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) == set(queries()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(results, key):
    r = results[key]
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "p_mod" in df.columns
