"""A stream in several batches gives what the batch operators give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, rows_of
from zephyra.operators import alerts, features
from zephyra.operators.alert_store import read_alerts
from zephyra.schemas import FEATURES
from zephyra.streaming.alerts import suppress_repeats_stream
from zephyra.streaming.features import stream_features
from zephyra.streaming.jobs import alert_sink, alert_stream, feature_table_sink, quarantine
from zephyra.streaming.scoring import (
    assemble_features,
    event_metrics,
    event_metrics_stream,
    latency_stats,
    stage_timing_stats,
)
from zephyra.workload import queries


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    """Readings in time order as four files, and the stream over them, one file per batch."""
    from zephyra.workload.views import readings

    rows = readings(spark, "/root/testdata/sf0.001").where("aqi is not null").withColumn("station_id", F.lit(0))
    path = str(tmp_path_factory.mktemp("stream") / "in")
    times = sorted(r["timestamp"] for r in rows.select("timestamp").collect())
    cuts = [times[len(times) * i // 4] for i in range(1, 4)]
    part = sum((F.when(F.col("timestamp") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(4):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)

    def stream():
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
        return source.parquet(path)

    return rows, stream


def finish(spark, df, folder):
    query = (
        df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def near(rows):
    return [tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in rows]


def test_features(spark, chunks, tmp_path):
    rows, stream = chunks
    made = finish(spark, stream_features(stream()), tmp_path)
    expected = features.event_features(rows)
    assert near(rows_of(made, "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))


def test_feature_table(spark, chunks, tmp_path):
    rows, stream = chunks
    query = feature_table_sink(
        stream(), f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/cp", hours=24 * 40, availableNow=True
    )
    query.awaitTermination()
    made = spark.read.parquet(f"{tmp_path}/out")
    expected = features.event_features(rows)
    assert near(rows_of(made, "seq", *FEATURES)) == near(rows_of(expected, "seq", *FEATURES))


def test_suppression(spark, chunks, tmp_path):
    rows, stream = chunks
    made = finish(spark, suppress_repeats_stream(alerts.rule_alerts(stream())), tmp_path)
    assert rows_of(made, "seq") == rows_of(alerts.suppress_repeats(alerts.rule_alerts(rows)), "seq")


def results(df):
    return df.select("seq", "city", "timestamp", F.col("aqi").alias("current_aqi"), (F.col("aqi") * 2).alias("predicted_aqi"))


def test_alert_flow_to_the_store(spark, chunks, tmp_path):
    rows, stream = chunks
    seen = []
    query = alert_sink(
        alert_stream(results(stream())), f"{tmp_path}/alerts", f"{tmp_path}/cp", [lambda b: seen.append(b.count())],
        availableNow=True,
    )
    query.awaitTermination()
    expected = alerts.alert_flow(results(rows))
    stored = read_alerts(spark, f"{tmp_path}/alerts")
    assert rows_of(stored, "alert_id") == rows_of(expected, "alert_id")
    assert sum(seen) == stored.count() and len(seen) >= 4


def test_quarantine(spark, chunks, tmp_path):
    _, stream = chunks
    marked = stream().select("seq", F.when(F.col("seq") % 10 == 0, "bad").alias("error"))
    query = quarantine(marked, f"{tmp_path}/bad", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/bad").where("error is null").count() == 0


def test_windowed_metrics(spark, chunks, tmp_path):
    rows, stream = chunks
    shape = lambda d: d.select("timestamp", F.col("aqi").alias("latency_ms"), (F.col("seq") % 5 != 0).alias("success"))
    made = finish(spark, event_metrics_stream(shape(stream()), width="1 day"), tmp_path)
    day = shape(rows).groupBy(F.date_trunc("day", "timestamp").alias("window_start")).agg(F.count("*").alias("n"))
    assert set(rows_of(made, "window_start", "event_count")) <= set(rows_of(day)) and made.count() > 20


def test_latency(spark):
    df = spark.range(1, 101).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("latency_ms"),
                                    (F.col("id") > 20).alias("success"))
    s = latency_stats(df, ["seq"], limit_ms=90, last=50).first()
    assert (s["events_processed"], s["events_exceeding_max"], s["min_latency_ms"]) == (100, 10, 51.0)
    assert s["p99_latency_ms"] >= s["p95_latency_ms"] >= s["median_latency_ms"]
    m = event_metrics(df).first()
    assert (m["event_count"], m["error_rate"]) == (100, 0.2)
    assert m["p95_latency_ms"] == pytest.approx(95.05) and m["p99_latency_ms"] >= 99.0
    empty = latency_stats(df.limit(0), ["seq"]).first()
    assert (empty["events_processed"], empty["mean_latency_ms"]) == (0, None)


def test_stage_times(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "operation string, seconds double")
    assert rows_of(stage_timing_stats(df)) == [("a", 2, 1.0, 3.0, 2.0, 4.0)]


def test_assembly(spark):
    df = spark.createDataFrame([(1.5, None, "x")], "a double, b double, c string")
    assert assemble_features(df, ["a", "b", "c", "d"]).first()["features"] == [1.5, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        assemble_features(df, [])


def test_micro_batches_are_bounded(spark, small, tmp_path, monkeypatch):
    """A city's part of a micro-batch is in one worker's memory, so their number grows with the readings."""
    monkeypatch.setattr(queries, "new_folder", lambda spark, name: str(tmp_path / name))
    queries.reading_stream(spark, SMALL, rows_per_batch=100)
    known = small.where("aqi is not null").count()
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/readings").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == known and len(sizes) >= known / 100 and max(sizes) < 150
