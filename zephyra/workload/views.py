"""The given tables as sensor readings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_readings(events: DataFrame) -> DataFrame:
    """Event types act as cities and values as readings. Nulls, high values and late stamps are set by rule."""
    seq = F.col("event_id")
    stamp = F.col("ts").cast("timestamp")
    return events.select(
        seq.alias("seq"),
        F.col("event_type").alias("city"),
        F.col("user_id").alias("station_id"),
        F.when(seq % 50 == 0, stamp - F.expr("INTERVAL 2 HOURS")).otherwise(stamp).alias("timestamp"),
        F.when(seq % 97 == 0, None).when(seq % 89 == 0, F.col("value") + 500).otherwise(F.col("value")).alias("aqi"),
        F.get_json_object("props", "$.k").cast("double").alias("pm25"),
        F.lit("events").alias("source"),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return as_readings(table(spark, folder, "events"))


READINGS_SQL = """
SELECT event_id AS seq, event_type AS city, user_id AS station_id,
       CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts END AS timestamp,
       CASE WHEN event_id % 97 = 0 THEN NULL
            WHEN event_id % 89 = 0 THEN value + 500 ELSE value END AS aqi,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pm25,
       'events' AS source
FROM events
"""
