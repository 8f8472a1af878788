"""Every query with SQL equals it at the smallest scale; the rest give rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.check import compare, database
from tests.conftest import SMALL
from zephyra.workload.queries import QUERIES

SLOW = {"train_boosted_trees", "predict", "model_feature_importance", "forecast_24h", "stream_score", "evaluate_all",
        "model_registry", "train_random_forest", "cross_validate"}


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in contract.oracle_sql()])
def test_equals_sql(spark, con, name):
    made = contract.queries()[name](spark, SMALL).toPandas()
    assert len(made) > 0
    assert compare(made, con.execute(contract.oracle_sql()[name]).df()) is None


def test_every_query_has_sql_but_fitted_models():
    assert set(QUERIES) - set(contract.oracle_sql()) == SLOW | {"table_fingerprint"}


def test_fingerprint_is_the_same_twice(spark):
    rows = contract.queries()["table_fingerprint"](spark, SMALL).collect()
    assert [r["runs"] for r in rows] == [2]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
