import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from zephyra.session import local_session  # noqa: E402
from zephyra.workload.views import readings  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(scope="session")
def small(spark):
    """Readings at the smallest scale, kept for the session."""
    rows = readings(spark, SMALL).cache()
    rows.count()
    return rows


@pytest.fixture
def hourly(spark):
    """``hourly(values, city=...)``: one reading per hour from midnight, ``seq`` in order."""

    def make(values, city="Delhi", start=datetime(2024, 1, 1), seq=0):
        rows = [
            (seq + i, city, start + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "seq long, city string, timestamp timestamp, aqi double")

    return make


def rows_of(df, *columns):
    """Rows as sorted tuples; nulls sort first."""
    df = df.select(*columns) if columns else df
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def by_seq(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("seq").select(*columns).collect()]
