"""Registered queries against their SQL on the smallest data set."""

import os

import pytest

from workload import registry
from workload.compare import check, sql_connection

SF_DIR = os.environ.get("LEDGERLENS_SF_DIR", "/root/testdata/sf0.001")
# Queries that SQL does not state: texts of several parts, and a fitted model's scores.
NO_SQL = {"ask_metrics", "ask_distribution", "ask_quality", "ask_summary", "score_summary"}
NAMES = sorted(n for n in registry.queries() if n not in NO_SQL)


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    ok, note = check(spark, con, SF_DIR, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs_without_sql(spark, name):
    assert name not in registry.oracle_sql()
    df = registry.queries()[name](spark, SF_DIR)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
