"""What streams keep, what their timers remove, and what can be read of it; complete windows; latency at the sink."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from zephyra.operators import alerts, features
from zephyra.schemas import FEATURES
from zephyra.streaming.alerts import state_entries, suppress_repeats_stream
from zephyra.streaming.features import state_readings, state_stats, stream_features
from zephyra.streaming.jobs import feature_table_sink, feature_table_writer
from zephyra.streaming.scoring import event_metrics, event_metrics_sink, finished_results, latency_sink, open_windows
from zephyra.streaming.state import read_state

START = datetime(2024, 3, 1)
READING = "seq long, city string, timestamp timestamp, aqi double"


def write(spark, path, rows, schema=READING):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema=READING):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, df, folder):
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def near(rows):
    return [tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in rows]


def two_cities():
    """One city ends after two hours, the other goes on for two days."""
    rows = [(i, "short", START + timedelta(minutes=13 * i), 100.0 + i) for i in range(9)]
    rows += [(100 + i, "long", START + timedelta(minutes=41 * i), 300.0 - i) for i in range(70)]
    return sorted(rows, key=lambda r: r[2])


def test_a_silent_city_leaves_the_state(spark, tmp_path):
    rows, path = two_cities(), f"{tmp_path}/in"
    for part in (rows[:25], rows[25:50], rows[50:]):
        write(spark, path, part)
    made = finish(spark, stream_features(source(spark, path), forget_hours=30, bucket_us=600_000_000), tmp_path)
    expected = features.event_features(spark.createDataFrame(rows, READING))
    assert near(rows_of(made, "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))
    for variable in ("summary", "rows", "clock", "older"):
        assert {r["key"]["city"] for r in read_state(spark, f"{tmp_path}/cp", variable).collect()} <= {"long"}
    window = features.window_state_stats(spark.createDataFrame(rows, READING))
    last = window.where("city = 'long'").orderBy(F.desc("timestamp")).limit(1).drop("timestamp")
    assert near(rows_of(state_stats(spark, f"{tmp_path}/cp"))) == near(rows_of(last))
    held = state_readings(spark, f"{tmp_path}/cp")
    assert held.count() < 45 and {r["aqi"] for r in held.collect()} <= {r[3] for r in rows}


def test_the_last_reading_of_a_silent_city_stays_until_it_is_forgotten(spark, tmp_path):
    rows, path = two_cities(), f"{tmp_path}/in"
    back = (500, "short", START + timedelta(hours=60), 1.0)
    for part in (rows[:25], rows[25:], [back]):
        write(spark, path, part)
    made = finish(spark, stream_features(source(spark, path)), tmp_path)
    expected = features.event_features(spark.createDataFrame([*rows, back], READING))
    assert near(rows_of(made, "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))


def test_late_rows_count_for_those_after_them(spark, tmp_path):
    path = f"{tmp_path}/in"
    first = [(i, "a", START + timedelta(minutes=10 * i), float(i * i % 17)) for i in range(60)]
    late = [(200 + i, "a", START + timedelta(minutes=10 * i + 5), float(i)) for i in range(56, 60)]
    after = [(300 + i, "a", START + timedelta(minutes=600 + 10 * i), float(i * 3)) for i in range(10)]
    for part in (first, late, after):
        write(spark, path, part)
    made = finish(spark, stream_features(source(spark, path), bucket_us=60_000_000), tmp_path)
    expected = features.event_features(spark.createDataFrame([*first, *late, *after], READING)).where("seq >= 300")
    assert made.count() == 74
    assert near(rows_of(made.where("seq >= 300"), "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))


def test_entries_of_sent_alerts_leave_the_state(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [(i, f"c{i % 3}", START + timedelta(minutes=11 * i), 180.0) for i in range(60)]
    marker = [(900, "marker", START + timedelta(hours=40), 180.0)]
    for part in (rows[:20], rows[20:], marker):
        write(spark, path, part)
    made = finish(spark, suppress_repeats_stream(alerts.rule_alerts(source(spark, path))), tmp_path)
    batch = spark.createDataFrame([*rows, *marker], READING)
    assert rows_of(made, "seq") == rows_of(alerts.suppress_repeats(alerts.rule_alerts(batch)), "seq")
    assert [r["city"] for r in state_entries(spark, f"{tmp_path}/cp").collect()] == ["marker"]


def test_all_windows_and_exact_percentiles(spark, tmp_path):
    schema, path = "timestamp timestamp, latency_ms double, success boolean", f"{tmp_path}/in"
    rows = [(START + timedelta(seconds=37 * i), None if i % 50 == 0 else float(i * 7919 % 1000), i % 9 != 0) for i in range(1500)]
    for part in (rows[:700], rows[700:]):
        write(spark, path, part, schema)
    event_metrics_sink(source(spark, path, schema), f"{tmp_path}/out", f"{tmp_path}/cp", width="1 hour", availableNow=True).awaitTermination()
    still = open_windows(spark, f"{tmp_path}/cp")
    closed = spark.read.parquet(f"{tmp_path}/out").select(still.columns)
    batch = spark.createDataFrame(rows, schema).withColumn("window_start", F.date_trunc("hour", "timestamp"))
    expected = event_metrics(batch, keys=["window_start"]).select(still.columns)
    assert still.count() >= 1 and closed.count() >= 10
    assert near(rows_of(closed.unionByName(still))) == near(rows_of(expected))


def test_latency_runs_to_the_end_of_a_slow_batch(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [(i, "a", START, 1.0) for i in range(3)])
    write(spark, path, [(10, "slow", START, 1.0)])

    @F.udf("string")
    def dawdle(city):
        if city == "slow":
            time.sleep(2)
        return city

    rows = source(spark, path).select("seq", dawdle("city").alias("city"), F.current_timestamp().alias("ingest_time"))
    latency_sink(rows, f"{tmp_path}/out", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    made = finished_results(spark, f"{tmp_path}/out", rows.schema)
    found = {r["seq"]: r["latency_ms"] for r in made.collect()}
    assert sorted(found) == [0, 1, 2, 10] and found[10] > 2000 and found[0] == found[1] == found[2] > 0
    assert finished_results(spark, f"{tmp_path}/none", rows.schema).count() == 0


def test_a_stream_without_watermark_keeps_its_entries(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [(1, "a", START, 180.0), (2, "a", START + timedelta(minutes=5), 180.0)])
    made = finish(spark, suppress_repeats_stream(alerts.rule_alerts(source(spark, path)), watermark=None), tmp_path)
    assert rows_of(made, "seq") == [(1,)] and state_entries(spark, f"{tmp_path}/cp").count() == 1
    with pytest.raises(ValueError):
        suppress_repeats_stream(alerts.rule_alerts(source(spark, path)), hours=0)


def test_late_readings_change_the_features_of_those_after_them(spark, tmp_path):
    """Out of order by hours, and across days: the table is what the batch operator gives for all readings."""
    path = f"{tmp_path}/in"
    rows = [(i, "ab"[i % 2], START + timedelta(minutes=97 * i), float(i * 31 % 400)) for i in range(90)]
    late = [r for r in rows if r[0] % 7 == 3]
    on_time = [r for r in rows if r[0] % 7 != 3]
    nowhen = [(700, "a", None, 1.0)]
    for part in (on_time[:30], late[:4] + nowhen, on_time[30:60], late[4:], on_time[60:]):
        write(spark, path, part)
    feature_table_sink(source(spark, path), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    made = spark.read.parquet(f"{tmp_path}/out")
    expected = features.event_features(spark.createDataFrame(rows, READING))
    assert near(rows_of(made, "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))
    assert spark.read.parquet(f"{tmp_path}/history").count() == 91


def test_old_lags_come_from_the_last_readings(spark, tmp_path):
    """A silence of a week: the next reading sees the one before it, and no folder in between was read."""
    path = f"{tmp_path}/in"
    rows = [(i, "a", START + timedelta(hours=5 * i), float(i)) for i in range(8)]
    rows += [(100 + i, "a", START + timedelta(days=9, hours=i), 50.0 + i) for i in range(5)]
    other = [(200 + i, "b", START + timedelta(hours=20 * i), float(-i)) for i in range(12)]
    everything = sorted(rows + other, key=lambda r: r[2])
    for i in range(0, len(everything), 5):
        write(spark, path, everything[i : i + 5])
    feature_table_sink(source(spark, path), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    made = spark.read.parquet(f"{tmp_path}/out")
    expected = features.event_features(spark.createDataFrame(everything, READING))
    assert near(rows_of(made, "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a", START + timedelta(hours=3 * i), float(i)) for i in range(20)], READING)
    first, second = rows.where("seq < 12"), rows.where("seq >= 12")
    put = feature_table_writer(f"{tmp_path}/history", f"{tmp_path}/out")
    for number, batch in ((0, first), (1, second)):
        put(batch, number)
    before = rows_of(spark.read.parquet(f"{tmp_path}/out"), "seq", *FEATURES)
    for number, batch in ((1, second), (0, first), (2, first.limit(0))):
        put(batch, number)
    assert rows_of(spark.read.parquet(f"{tmp_path}/out"), "seq", *FEATURES) == before and len(before) == 20
    assert spark.read.parquet(f"{tmp_path}/history").count() == 20
