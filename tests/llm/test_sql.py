"""Every query of this package that SQL can express equals it at the smallest scale."""

from __future__ import annotations

import pytest

from tests.check import compare, database
from tests.conftest import SMALL
from zephyra.llm.oracle import ORACLE
from zephyra.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    made = QUERIES[name](spark, SMALL).toPandas()
    assert len(made) > 0
    assert compare(made, database(SMALL).execute(ORACLE[name]).df()) is None


def test_there_is_a_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
