"""Every query with a SQL counterpart, on the smallest tables, plus the registry's own rules."""

import pytest

import __spark_entry__ as entry
from oracle.sql import SQL
from siftpage.plans.queries import REGISTRY
from tools.check import compare, connect

ROWS_ONLY = {"model_scores", "feature_importance", "permutation_importance", "full_prediction"}
SLOW = ROWS_ONLY


def test_registry():
    assert set(REGISTRY) - set(SQL) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SLOW))
def test_query(spark, con, folder, name):
    assert compare(spark, con, folder, name).startswith("ok")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "label", "confidence", "method", "reason"]
    assert df.count() == 50
