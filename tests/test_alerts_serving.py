from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_seq, rows_of
from zephyra.operators import alert_store, alerts, serving

AT = datetime(2024, 1, 1)


@pytest.fixture
def at(spark):
    def make(*values):
        rows = [(i, "Delhi", AT, float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "seq long, city string, timestamp timestamp, aqi double")

    return make


def test_rules(at):
    found = alerts.rule_alerts(at(50, 75, 150, 250, 350, 600, 50.5, 122.25))
    assert by_seq(found, "seq") == [1, 2, 3, 4, 7]
    assert by_seq(found, "level") == ["info", "warning", "severe", "critical", "warning"]
    assert by_seq(found, "message")[-1] == "Delhi: AQI 122.2 (Moderately Polluted)"
    assert rows_of(found.where("seq = 2"), "threshold_min", "threshold_max") == [(101, 200)]


def test_predictions(at):
    df = at(150, 200, 90, 301).withColumnRenamed("aqi", "predicted_aqi")
    found = alerts.model_alerts(df)
    assert by_seq(found, "level") == ["warning", "critical"]
    assert by_seq(found, "message")[0] == "Delhi: Predicted AQI 200.0 exceeds threshold (150)"
    assert by_seq(alerts.model_alerts(df, 80), "level")[1:3] == ["warning", "info"]
    preview = alerts.alert_preview(df)
    assert by_seq(preview, "will_trigger_alert") == [False, True, False, True]
    for wrong in (-1, "high", True):
        with pytest.raises(ValueError):
            alerts.model_alerts(df, wrong)


def test_ids_are_stable(at):
    first, again = (alerts.rule_alerts(at(75, 150)) for _ in range(2))
    assert by_seq(first, "alert_id") == by_seq(again, "alert_id")
    assert len(set(by_seq(first, "alert_id"))) == 2


def test_state(spark):
    rows = [("Delhi", "info", AT), ("Delhi", "info", AT + timedelta(hours=2)), ("Mumbai", "severe", AT)]
    sent = spark.createDataFrame(rows, "city string, level string, timestamp timestamp")
    state = alerts.suppression_state(sent, F.lit(AT + timedelta(hours=2, minutes=30)))
    assert rows_of(state, "city", "seconds_until_next", "expired") == [("Delhi", 1800.0, False), ("Mumbai", 0.0, True)]
    assert rows_of(alerts.suppression_totals(state)) == [(1, 2, 2, 2)]


def test_flow_shares_the_key_between_kinds(spark):
    rows = [(0, "Delhi", AT, 150.0, 180.0), (1, "Delhi", AT + timedelta(minutes=5), 40.0, 350.0)]
    df = spark.createDataFrame(
        rows, "seq long, city string, timestamp timestamp, current_aqi double, predicted_aqi double"
    )
    made = alerts.alert_flow(df)
    assert rows_of(made, "alert_type", "level") == [("model_based", "critical"), ("rule_based", "warning")]


@pytest.fixture
def store(spark, tmp_path, at):
    rows = [
        (i, city, AT + timedelta(hours=h), float(v))
        for i, (city, h, v) in enumerate([("Delhi", 0, 150), ("Delhi", 30, 250), ("Mumbai", 30, 150), ("Mumbai", 31, 400)])
    ]
    df = spark.createDataFrame(rows, "seq long, city string, timestamp timestamp, aqi double")
    path = f"{tmp_path}/alerts"
    assert alert_store.read_alerts(spark, path).count() == 0
    alert_store.store_alerts(alerts.rule_alerts(df).drop("seq"), path)
    table = alert_store.read_alerts(spark, path)
    acks_path = f"{tmp_path}/acks"
    ids = table.where("level = 'critical'").select("alert_id").unionByName(spark.createDataFrame([("none",)], "alert_id string"))
    acks = alert_store.acknowledgements(table, ids, "me")
    assert acks.count() == 1
    alert_store.store_acknowledgements(acks, acks_path)
    return table, alert_store.read_acknowledgements(spark, acks_path)


def test_store(store):
    table, acks = store
    now = F.lit(AT + timedelta(hours=32))
    assert table.count() == 4 and "threshold_min" not in table.columns
    wanted = table.first()["alert_id"]
    assert alert_store.get_alert(table, wanted).count() == 1
    active = alert_store.active_alerts(table, acks).collect()
    assert [r["level"] for r in active] and len(active) == 3
    assert [r["timestamp"] for r in active] == sorted((r["timestamp"] for r in active), reverse=True)
    assert alert_store.active_alerts(table, acks, city="Mumbai").count() == 1
    assert alert_store.active_alerts(table, acks, level="warning").count() == 2
    city = alert_store.alerts_by_city(table, acks, "Mumbai", now)
    assert [r["acknowledged"] for r in city.collect()] == [True, False]
    assert alert_store.alerts_by_city(table, acks, "Mumbai", now, acknowledged=True).first()["acknowledged_by"] == "me"
    assert alert_store.alerts_by_city(table, acks, "Delhi", now).count() == 1
    assert alert_store.alerts_by_level(table, "warning", now, 48).count() == 2
    stats = {(r["grouping"], r["city"] or r["level"]): (r["total_alerts"], r["active_alerts"])
             for r in alert_store.alert_stats(table, acks, now).collect()}
    assert stats["all", None] == (3, 2) and stats["city", "Mumbai"] == (2, 1) and stats["level", "critical"] == (1, 0)


def test_store_prunes_dates(store):
    table, _ = store
    found = alert_store.alerts_by_level(table, "warning", F.lit(AT + timedelta(hours=32)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_incomplete_alerts_are_named(spark):
    with pytest.raises(ValueError):
        alert_store.stored_form(spark.createDataFrame([("a",)], "city string"))
    row = spark.createDataFrame([("rule_based", None, "info", AT)], "alert_type string, city string, level string, timestamp timestamp")
    assert alert_store.unstorable(row).count() == 1


def test_serving(spark, hourly):
    df = hourly([1, 2, 3]).unionByName(hourly([7], "Mumbai", seq=10)).unionByName(hourly([9], "Pune", seq=20))
    assert rows_of(serving.latest_by_city(df), "city", "aqi") == [("Delhi", 3.0), ("Mumbai", 7.0), ("Pune", 9.0)]
    now = F.lit(AT + timedelta(hours=1))
    assert rows_of(serving.history(df, ["Delhi", "Mumbai"], now, 1), "city", "aqi") == [
        ("Delhi", 1.0), ("Delhi", 2.0), ("Mumbai", 7.0),
    ]
    assert serving.city_list(df).count() == 3 and serving.city_list(spark=spark).count() == 10


def test_fingerprint(hourly):
    df = hourly([1, 2, 3, None])
    first = serving.table_fingerprint(df).first()
    assert first == serving.table_fingerprint(df.repartition(3, "aqi").select(*reversed(df.columns))).first()
    assert first != serving.table_fingerprint(df.withColumn("aqi", F.col("aqi") + 1)).first()
    assert serving.table_fingerprint(df.limit(0)).first()["records"] == 0
