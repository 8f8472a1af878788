"""Profiles from daily summaries against the exact ones."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from zephyra.operators import rollups

SCHEMA = "timestamp timestamp, a double, b int, c double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    start = datetime(2024, 1, 1)
    rows = [
        (start + timedelta(minutes=int(m)), float(v) if m % 7 else None, int(v) % 50, float("nan"))
        for m, v in zip(rng.integers(0, 40 * 1440, 20_000), rng.gamma(2, 100, 20_000), strict=True)
    ]
    made = spark.createDataFrame([*rows, (None, 1.0, 1, 1.0)], SCHEMA).cache()
    return made


def test_a_month_from_daily_summaries(spark, table, tmp_path):
    path = f"{tmp_path}/summaries"
    rollups.write_summaries(rollups.daily_summaries(table), path)
    made = {r["feature"]: r for r in rollups.profile_of(rollups.read_summaries(spark, path), "2024-01-01", date(2024, 1, 31)).collect()}
    month = table.where("timestamp < '2024-02-01'").toPandas()
    for name in ("a", "b"):
        r, values = made[name], month[name].dropna()
        assert (r["records"], r["missing"]) == (len(month), month[name].isna().sum())
        assert (r["min"], r["max"]) == (values.min(), values.max())
        assert r["mean"] == pytest.approx(values.mean(), rel=1e-12) and r["std"] == pytest.approx(values.std(), rel=1e-10)
        assert r["distinct"] == pytest.approx(values.nunique(), rel=0.03)
        for q, p in rollups.QUARTILES.items():  # the error of a sketch is one of ranks
            assert (values < r[q]).mean() - 0.015 <= p <= (values <= r[q]).mean() + 0.015
    assert (made["c"]["missing_pct"], made["c"]["median"], made["c"]["mean"], made["c"]["std"], made["c"]["distinct"]) == (100.0, None, None, None, 0)


def test_a_date_is_replaced_alone(spark, table, tmp_path):
    path = f"{tmp_path}/summaries"
    rollups.write_summaries(rollups.daily_summaries(table, ["a"]), path)
    day = table.where(F.to_date("timestamp") == "2024-01-05")
    rollups.write_summaries(rollups.daily_summaries(day.withColumn("a", F.col("a") + 1), ["a"]), path)
    before, after = rollups.daily_summaries(table, ["a"]), rollups.read_summaries(spark, path)
    names = ["date", "records", "n", "min", "max"]
    changed = set(rows_of(after, *names)) ^ set(rows_of(before, *names))
    assert {r[0] for r in changed} == {date(2024, 1, 5)} and len(changed) == 2
    assert after.count() == before.count()


def test_nothing(spark, table, tmp_path):
    assert rollups.profile_of(rollups.read_summaries(spark, f"{tmp_path}/none")).count() == 0
    assert rollups.daily_summaries(table.limit(0)).count() == 0
