from __future__ import annotations

from datetime import datetime

import pytest

from tests.conftest import by_seq, rows_of
from zephyra.functions.calendar import calendar_parts
from zephyra.operators import features, scaling


def test_row_lags_and_windows(hourly):
    df = hourly(range(10, 110, 10))
    made = features.rolling_rows(features.lag_rows(df))
    assert by_seq(made, "aqi_lag_1h")[:3] == [None, 10.0, 20.0]
    assert by_seq(made, "aqi_lag_3h")[3] == 10.0
    assert by_seq(made, "aqi_mean_3h")[2:4] == [20.0, 30.0]
    assert by_seq(made, "aqi_std_3h")[:3] == [None, pytest.approx(50**0.5), 10.0]
    assert by_seq(made, "aqi_min_3h")[4] == 30.0 and by_seq(made, "aqi_max_24h")[9] == 100.0


def test_cities_do_not_mix(hourly):
    both = hourly([10, 20, 30]).unionByName(hourly([100, 110, 120], "Mumbai", seq=10))
    made = features.rolling_rows(features.lag_rows(both))
    assert by_seq(made, "aqi_mean_3h") == [10.0, 15.0, 20.0, 100.0, 105.0, 110.0]
    assert by_seq(made, "aqi_lag_1h")[3] is None


def test_range_windows_close_both_ends(hourly):
    made = features.rolling_range(hourly([1, 2, 3, 4, 5]), sizes=[3])
    assert by_seq(made, "aqi_mean_3h") == [1.0, 1.5, 2.0, 2.5, 3.5]
    assert by_seq(made, "aqi_std_3h")[0] is None


def test_event_lags_and_open_windows(hourly):
    df = hourly([100, 110, 120, 130, 125])
    made = features.event_features(df)
    assert by_seq(made, "aqi_lag_1h")[3] == 120.0 and by_seq(made, "aqi_lag_3h")[3] == 100.0
    # the start of the window and the row itself are outside
    assert by_seq(made, "aqi_mean_3h")[3] == 115.0 and by_seq(made, "aqi_std_3h")[3] == 5.0
    assert by_seq(made, "aqi_min_3h")[4] == 120.0 and by_seq(made, "aqi_max_3h")[4] == 130.0
    assert by_seq(made, "aqi_mean_3h")[0] is None


def test_a_lag_takes_the_latest_known_value_however_old(spark):
    rows = [(0, "a", datetime(2024, 1, 1), 7.0), (1, "a", datetime(2024, 1, 1), 8.0),
            (2, "a", datetime(2024, 3, 1), None), (3, "a", datetime(2024, 5, 1), 9.0)]
    df = spark.createDataFrame(rows, "seq long, city string, timestamp timestamp, aqi double")
    made = features.asof_lags(df)
    assert by_seq(made, "aqi_lag_24h") == [None, None, 8.0, 8.0]


def test_day_old_values_leave_the_buffer_but_reach_the_lag(hourly):
    df = hourly(range(30))
    stats = features.window_state_stats(df).orderBy("timestamp").collect()
    assert [r["buffer_size"] for r in stats][22:26] == [23, 24, 24, 24]
    assert stats[29]["time_span_hours"] == 23.0
    assert by_seq(features.asof_lags(df), "aqi_lag_24h")[24] == 0.0


def test_calendar(spark):
    days = [datetime(2024, 1, d, 10) for d in (5, 6, 7, 8)]  # Friday to Monday
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "seq long, timestamp timestamp")
    made = features.temporal_parts(df)
    assert by_seq(made, "day_of_week") == [4, 5, 6, 0]
    assert by_seq(made, "is_weekend") == [0, 1, 1, 0]
    assert by_seq(made, "hour_of_day") == [10] * 4
    sunday = features.temporal_parts(df, week="sunday")
    assert by_seq(sunday, "day_of_week") == [5, 6, 0, 1]
    assert by_seq(sunday, "is_weekend") == [1, 1, 0, 0]
    with pytest.raises(ValueError):
        calendar_parts(week="tuesday")


def test_seasons(spark):
    df = spark.createDataFrame([(m, datetime(2024, m, 1)) for m in range(1, 13)], "seq long, timestamp timestamp")
    names = by_seq(features.add_season(df), "season")
    assert names == ["Winter"] * 2 + ["Summer"] * 3 + ["Monsoon"] * 4 + ["Post-Monsoon"] * 2 + ["Winter"]


def test_fill(hourly):
    df = hourly([None, 5, None, 7]).unionByName(hourly([None, None], "Mumbai", seq=10))
    assert by_seq(features.fill_missing(df), "aqi") == [5.0, 5.0, 5.0, 7.0, 0.0, 0.0]


def test_gold_keeps_lags_empty_and_sees_values_before_filling(hourly):
    gold = features.build_gold(hourly([10, None, 30]))
    assert by_seq(gold, "aqi") == [10.0, 10.0, 30.0]
    assert by_seq(gold, "aqi_lag_1h") == [None, 10.0, None]
    filled = features.fill_missing(gold, ["aqi_lag_1h"])
    assert by_seq(filled, "aqi_lag_1h") == [10.0, 10.0, 10.0]
    assert features.build_gold(hourly([1, 2]), mode="range").columns == gold.columns
    with pytest.raises(ValueError):
        features.build_gold(hourly([1]), mode="other")


def test_gold_needs_one_shuffle(small):
    plan = features.build_gold(small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_prior_features_do_not_see_the_row(hourly):
    made = features.prior_features(hourly([1, 2, 3, 4]))
    assert by_seq(made, "aqi_mean_3h") == [None, 1.0, 1.5, 2.0]


def test_scaler(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "b")], "x double, k double, city string")
    params = scaling.scaler_fit(df)
    assert rows_of(params) == [(0, "x", 2.0, 1.0, 1.0), (1, "k", 5.0, 0.0, 1.0)]
    scaling.scaler_save(params, f"{tmp_path}/scaler")
    loaded = scaling.scaler_load(spark, f"{tmp_path}/scaler")
    made = scaling.scaler_transform(df, loaded)
    assert rows_of(made) == [(-1.0, 0.0, "a"), (1.0, 0.0, "b")]
    with pytest.raises(ValueError):
        scaling.scaler_transform(df.drop("x"), loaded)


def test_only_needed_columns_are_read(spark):
    from zephyra.workload.views import readings

    plan = features.lag_rows(readings(spark, "/root/testdata/sf0.01").select("seq", "city", "timestamp", "aqi"))
    scan = [line for line in plan._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line][-1]
    assert "props" not in scan and "user_id" not in scan
