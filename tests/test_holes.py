"""Inputs that are rare in the given tables: nulls in orders, odd numbers, odd files, one busy value, another working folder."""

from __future__ import annotations

import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, rows_of
from zephyra.operators import alerts, profile, splits
from zephyra.plans.quantiles import quantiles
from zephyra.sources import events, landing

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("limit", [4_000_000, 3])
def test_rows_without_time_come_first(spark, limit):
    stamps = [None if i % 10 == 0 else datetime(2024, 1, 1 + i // 10, i % 10) for i in range(100)]
    rows = spark.createDataFrame(list(enumerate(stamps)), "seq long, timestamp timestamp")
    order = sorted(range(100), key=lambda i: (stamps[i] is not None, stamps[i] or 0, i))
    split = {r["seq"]: r["role"] for r in splits.holdout_split(rows, 0.2, limit=limit).collect()}
    assert [i for i in order if split[i] == "train"] == order[:80]
    folds = splits.expanding_folds(rows, 3, limit=limit).collect()
    for fold in (1, 2, 3):
        assert {r["seq"] for r in folds if (r["fold"], r["role"]) == (fold, "train")} == set(order[: 25 * fold])
        assert {r["seq"] for r in folds if (r["fold"], r["role"]) == (fold, "test")} == set(order[25 * fold : 25 * fold + 25])


def test_quantiles_are_the_same_rows_for_any_size(spark):
    data = [(k, float(v) if v % 7 else None, None, 1e300 if v == 3 else float("nan") if v == 4 else v / 3) for k in "ab" for v in range(40)]
    rows = spark.createDataFrame([*data, ("c", None, None, float("-inf"))], "k string, x double, nothing double, wide double")
    for keys in ([], ["k"]):
        both = [rows_of(quantiles(rows, ["x", "nothing", "wide"], [0.0, 0.25, 0.5, 0.99], keys, limit).fillna(-1.0)) for limit in (10**9, 0)]
        assert [r[:-1] for r in both[0]] == [r[:-1] for r in both[1]]
        assert [r[-1] for r in both[0]] == pytest.approx([r[-1] for r in both[1]], nan_ok=True)
    one = profile.feature_statistics(rows, ["nothing"], limit=0)
    assert one.count() == profile.feature_statistics(rows, ["nothing"]).count() == 12


def test_one_far_value_does_not_gather_the_others(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") == 5, 1e300).otherwise(F.col("id") / 7).alias("x"))
    got = {r["p"]: r["value"] for r in quantiles(rows, ["x"], [0.5, 1.0], limit=0).collect()}
    assert got == {0.5: pytest.approx(100_000 / 7, rel=1e-4), 1.0: 1e300}


def test_messages_with_odd_numbers(spark):
    stamps = ["1e300", '"NaN"', '"-Infinity"', '"soon"', "5.5"]
    texts = [f'{{"city": "a", "timestamp": {s}, "aqi": 1, "pollutants": {{"pm25": "NaN"}}}}' for s in stamps]
    texts.append('{"city": "a", "timestamp": 1, "aqi": "Infinity"}')
    made = events.decode_events(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [r["error"] for r in made] == [*["timestamp is not a number"] * 4, None, "aqi is not a number"]
    assert made[4]["pollutants"] == {"pm25": None}


def test_csv_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text("timestamp,city,aqi\n2024-01-01,Delhi,5\n")
    (tmp_path / "b c.csv").write_text('﻿aqi,note,city\n6,"x, y",Pune\n7,short\n')
    (tmp_path / "empty.csv").write_text("")
    rows = landing.read_history_csv(spark, str(tmp_path))
    assert {"city", "timestamp", "aqi", "pm25", "note"} <= set(rows.columns)
    assert rows_of(rows.where("city is not null"), "city", "aqi", "timestamp", "note") == [
        ("Delhi", "5", "2024-01-01", None), ("Pune", "6", None, "x, y")
    ]
    (tmp_path / "none").mkdir()
    assert landing.read_history_csv(spark, str(tmp_path / "none")).count() == 0


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
print('ROWS', e.queries()['suppress_repeats'](spark, {SMALL!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_regular_cadence_over_many_chunks(spark):
    """Maps never shrink on a regular cadence; chunks are joined two at a time."""
    rows = spark.range(900).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, "a").alias("city"), F.lit("warning").alias("level"),
        F.timestamp_millis(F.col("id") * 10 + 5_000_000).alias("timestamp"),
    )
    rows = rows.union(rows.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).withColumn("seq", F.col("seq") + 900))
    whole, cut = (rows_of(alerts.suppress_repeats(rows, 1, limit=limit), "seq") for limit in (10**6, 40))
    assert whole == cut and len(whole) == 4
