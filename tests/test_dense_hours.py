"""Hours that hold more instants than a task should are cut, and give the same rows as plain RANGE frames."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows_of
from zephyra.operators import features
from zephyra.plans import hours

START = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def dense(spark):
    """Two cities over two days; one has an hour with most of its readings, many of them in one second, some at one instant."""
    rng = np.random.default_rng(2)
    at = [int(x) for x in rng.integers(0, 48 * 3600, 150)]
    micros = [(x * 1_000_000, "a" if i % 2 else "b") for i, x in enumerate(at)]
    micros += [(20 * 3_600_000_000 + int(x), "a") for x in rng.integers(0, 3_600_000_000, 300)]
    micros += [(20 * 3_600_000_000 + 1_000_000_000 + int(x), "a") for x in rng.integers(0, 1_000_000, 200)]
    micros += [(20 * 3_600_000_000 + 1_000_000_000, "a")] * 20
    micros += [(20 * 3_600_000_000 + 1_000_000_000 + h * 3_600_000_000, "a") for h in (1, 3, 6, 12, 24)]
    rows = [
        (i, c, START + timedelta(microseconds=us), None if i % 23 == 0 else float(rng.integers(0, 500)))
        for i, (us, c) in enumerate(micros)
    ]
    rows += [(9000, "a", None, 5.0), (9001, None, START, 6.0)]
    made = spark.createDataFrame(rows, "seq long, city string, timestamp timestamp, aqi double").repartition(4).cache()
    made.count()
    return made


def near(df):
    names = ["seq", *[c for c in df.columns if c.startswith("aqi_")]]
    return [pytest.approx(r, rel=1e-9, abs=1e-7) if None not in r else Partly(r) for r in rows_of(df, *names)]


class Partly(tuple):
    """A row with nulls, whose numbers may differ in their last digits."""

    def __eq__(self, other):
        return all(a == b or (None not in (a, b) and a == pytest.approx(b, rel=1e-9, abs=1e-7)) for a, b in zip(self, other, strict=True))

    __hash__ = None


def same(made, expected):
    made, expected = values(made), near(expected)
    assert len(made) == len(expected) and [i for i, (a, b) in enumerate(zip(expected, made, strict=True)) if not a == b] == []


def values(df):
    return rows_of(df, "seq", *[c for c in df.columns if c.startswith("aqi_")])


@pytest.mark.parametrize("make", [features.rolling_range, features.event_features])
def test_cut_hours_equal_whole_ones(dense, make, monkeypatch):
    whole, chunks = make(dense, limit=1_000_000), []

    def spy(*args):
        made = real(*args)
        chunks.append(made.groupBy("_k0", "_hour").agg(F.max("_chunk").alias("n")).agg(F.max("n")).first()[0] + 1)
        return made

    real = hours.chunk_rows
    monkeypatch.setattr(hours, "chunk_rows", spy)
    limit = 50
    same(make(dense, limit=limit), whole)
    assert chunks and chunks[0] >= 10  # an hour of ten times the limit is that many chunks


def test_plain_frames(dense):
    """The cut plan against Spark's own RANGE frame."""
    us = F.unix_micros("timestamp")
    hour = 3_600_000_000
    by = Window.partitionBy("city").orderBy(us)
    made = features.rolling_range(dense, sizes=[3], limit=40).where("timestamp is not null")
    frame = by.rangeBetween(-3 * hour, 0)
    plain = dense.where("timestamp is not null").select(
        "seq", F.avg("aqi").over(frame).alias("aqi_mean_3h"), F.stddev_samp("aqi").over(frame).alias("aqi_std_3h"),
        F.min("aqi").over(frame).alias("aqi_min_3h"), F.max("aqi").over(frame).alias("aqi_max_3h"),
    )
    same(made, plain)
    open_frame = by.rangeBetween(1 - 6 * hour, -1)
    made = features.trailing_stats(dense, sizes=[6], limit=40).where("timestamp is not null")
    plain = dense.where("timestamp is not null").select(
        "seq", F.avg("aqi").over(open_frame).alias("aqi_mean_6h"), F.stddev_pop("aqi").over(open_frame).alias("aqi_std_6h"),
        F.min("aqi").over(open_frame).alias("aqi_min_6h"), F.max("aqi").over(open_frame).alias("aqi_max_6h"),
    )
    same(made, plain)


def test_state_of_a_dense_hour(dense):
    one, many = (features.window_state_stats(dense, limit=n) for n in (1_000_000, 50))
    names = ["city", "buffer_size", "oldest_timestamp", "newest_timestamp"]
    assert rows_of(one, *names) == rows_of(many, *names)


def test_gold_over_ranges(dense):
    one, many = (features.build_gold(dense, mode="range", limit=n) for n in (1_000_000, 60))
    same(one, many)


def test_tasks_grow_with_the_questions(spark, dense, monkeypatch):
    """The sorts over the hours get more tasks than the default where the rows ask for them, and the rows are the same."""
    def made():
        return features.trailing_stats(dense)

    usual = made()
    monkeypatch.setattr(hours, "QUESTIONS_PER_TASK", 100)
    assert hours._tasks(dense, 5) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = made()
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert f", {hours._tasks(dense, 5)}), REPARTITION_BY_NUM" in plan
    assert rows_of(spread) == rows_of(usual)
