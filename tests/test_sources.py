from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_seq, rows_of
from zephyra.operators import clean
from zephyra.schemas import BRONZE, SILVER
from zephyra.sources import events, landing, tables
from zephyra.streaming.scoring import validate_event


def test_csv_folder(spark, tmp_path):
    header = "city,timestamp,aqi,pm25,pm10,no2,o3,so2,co\n"
    (tmp_path / "a.csv").write_text(header + "Delhi,2024-01-01 00:00:00,150,1,2,3,4,5,6\nDelhi,someday,600,,,,,,\n")
    (tmp_path / "b.csv").write_text(header + ",2024-01-01 01:00:00,high,NaN,,,,,\nPune,2024-01-01\n")
    raw = landing.read_history_csv(spark, str(tmp_path))
    assert raw.count() == 4
    assert raw.toPandas()["_corrupt_record"].notna().sum() == 1
    made = landing.coerce_types(raw)
    assert dict(made.dtypes)["timestamp"] == "timestamp" and dict(made.dtypes)["aqi"] == "double"
    assert made.where("pm25 is not null").count() == 1  # NaN became null
    counts = landing.coercion_counts(raw).first()
    assert (counts["unparsable_timestamps"], counts["unparsable_aqi"]) == (1, 1)


def test_feed(spark):
    def body(**data):
        return json.dumps({"status": "ok", "data": data})

    iso = {"iso": "2024-01-01T10:00:00+05:30"}
    payloads = [
        body(aqi=150, time=iso, iaqi={"pm25": {"v": 55.5}}), body(aqi="600", time=iso, iaqi={}),
        body(aqi="-", time=iso), body(time=iso), json.dumps({"status": "error"}), json.dumps({"status": "ok"}),
        "not json", body(aqi=1),
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "seq long, payload string")
    made = landing.flatten_feed_json(df, F.lit("Delhi"))
    assert by_seq(made, "reason") == [
        None, None, "invalid aqi", "missing aqi", "bad status", "no data", "bad status", None,
    ]
    good = landing.accepted(made).orderBy("seq").collect()
    assert (good[0]["pm25"], good[0]["no2"], good[1]["aqi"]) == (55.5, None, 600.0)
    assert good[0]["timestamp"] is not None and good[2]["timestamp"] is not None  # the last one: time of ingest
    assert landing.rejected(made).count() == 5


def test_messages(spark):
    values = [
        '{"city": "Delhi", "timestamp": 1000000.5, "aqi": 120, "pollutants": {"pm25": 5, "xx": 1}}', "{broken",
        '{"city": "Delhi", "timestamp": 1}', '{"timestamp": 1, "aqi": 2}', '{"city": "Delhi", "timestamp": "soon", "aqi": 2}',
        '{"city": "Delhi", "timestamp": 1, "aqi": "high"}',
    ]
    df = spark.createDataFrame([(i, v.encode()) for i, v in enumerate(values)], "seq long, value binary")
    made = events.decode_events(df)
    assert by_seq(made, "error") == [
        None, "invalid JSON", "missing aqi", "missing city", "timestamp is not a number", "aqi is not a number",
    ]
    row = events.spread_pollutants(events.good_events(made)).select("*", F.unix_micros("timestamp").alias("us")).first()
    assert (row["us"], row["aqi"], row["pm25"], row["co"]) == (1_000_000_500_000, 120.0, 5.0, None)
    assert events.bad_events(made).count() == 5


def test_routing(spark, tmp_path):
    rows = [("New Delhi", 1.0, 100.0), ("New Delhi", None, 100.0), ("Pune", 2.0, 50.0)]
    df = spark.createDataFrame(rows, "city string, timestamp double, aqi double")
    routed = events.encode_and_route_events(df, "aqi")
    assert rows_of(routed, "topic", "value") == [
        ("aqi_new delhi", '{"city":"New Delhi","timestamp":1.0,"aqi":100.0}'),
        ("aqi_pune", '{"city":"Pune","timestamp":2.0,"aqi":50.0}'),
    ]
    assert rows_of(events.route_counts(df)) == [("New Delhi", 1, 1), ("Pune", 1, 0)]
    events.write_messages(routed, "json", path=f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_validation(spark):
    rows = [("a", "1", "2"), (None, "1", "2"), ("a", None, "2"), ("a", "1", None), ("a", "x", "2"), ("a", "1", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, city string, timestamp string, aqi string")
    assert by_seq(validate_event(df), "error") == [
        None, "missing city", "missing timestamp", "missing aqi", "timestamp is not a number", "aqi is not a number",
    ]


@pytest.fixture
def three(spark):
    rows = [("Delhi", datetime(2024, 1, 1, 5), 1.0), ("Delhi", datetime(2024, 1, 2, 5), 2.0), ("Pune", datetime(2024, 1, 2), 3.0)]
    return spark.createDataFrame(rows, "city string, timestamp timestamp, aqi double")


def test_bronze(spark, tmp_path, three):
    path = f"{tmp_path}/bronze"
    assert tables.read_bronze(spark, path).count() == 0
    assert tables.write_bronze(three, path, "one") == 3
    assert tables.write_bronze(three.limit(1), path, "two") == 1
    assert tables.read_bronze(spark, path).count() == 4
    found = tables.read_bronze(spark, path, source="one", date="2024-01-02")
    assert found.count() == 2
    assert set(BRONZE.fieldNames()) | {"date"} == set(found.columns)
    assert "PartitionFilters: [isnotnull(source" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(clean.SchemaError):
        tables.write_bronze(three.drop("aqi"), path, "one")


def test_layers(spark, tmp_path, three):
    path = f"{tmp_path}/silver"
    assert tables.read_layer(spark, path, SILVER).count() == 0
    tables.write_layer(three, path)
    assert tables.read_layer(spark, path, SILVER, city="Delhi").count() == 2
    assert tables.read_layer(spark, path, SILVER, city="Delhi", date="2024-01-02").count() == 1


def test_report(spark, tmp_path, three):
    tables.write_report_json(three, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 3
