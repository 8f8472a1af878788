"""Event messages: JSON in and out, for any source and sink format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyra.schemas import POLLUTANTS

# fixed value: all fields as text first, so that a wrong type can be told from a missing field
_RAW = "city string, timestamp string, aqi string, pollutants map<string,string>"


def read_messages(spark: SparkSession, fmt: str = "kafka", **options) -> DataFrame:
    """A stream of messages with a ``value`` column. Offsets, groups and commits are options and the checkpoint."""
    reader = spark.readStream.format(fmt)
    if fmt in ("text", "json", "parquet", "csv"):
        schema = options.pop("schema", "value string")
        path = options.pop("path")
        return reader.schema(schema).options(**options).load(path)
    return reader.options(**options).load()


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """``value`` to ``city, timestamp, aqi, pollutants`` and ``error``, which is NULL for a good event.

    ``timestamp`` is taken in seconds since the epoch and becomes a TIMESTAMP. NaN, infinity, and seconds that no TIMESTAMP
    holds are no numbers. Other columns pass through.
    """
    keep = [F.col(c) for c in messages.columns if c != value]
    parsed = messages.withColumn("_text", F.col(value).cast("string")).withColumn("_e", F.from_json("_text", _RAW))
    seconds, aqi = finite("_e.timestamp"), finite("_e.aqi")
    micros = F.round(seconds * 1e6).try_cast("long")
    error = (
        F.when(F.try_parse_json("_text").isNull(), "invalid JSON")
        .when(F.col("_e.city").isNull(), "missing city")
        .when(F.col("_e.timestamp").isNull(), "missing timestamp")
        .when(F.col("_e.aqi").isNull(), "missing aqi")
        .when(micros.isNull(), "timestamp is not a number")
        .when(aqi.isNull(), "aqi is not a number")
    )
    return parsed.select(
        *keep,
        F.col("_e.city").alias("city"),
        F.timestamp_micros(micros).alias("timestamp"),
        aqi.alias("aqi"),
        F.transform_values("_e.pollutants", lambda _, v: finite(v)).alias("pollutants"),
        error.alias("error"),
    )


def finite(value: Column | str) -> Column:
    """A number, or NULL for NaN, infinity and what is no number."""
    number = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def good_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull()).drop("error")


def bad_events(decoded: DataFrame) -> DataFrame:
    """For the quarantine sink."""
    return decoded.where(F.col("error").isNotNull())


def spread_pollutants(events: DataFrame, names: list[str] = POLLUTANTS) -> DataFrame:
    """The ``pollutants`` map as one column per known name."""
    return events.select(
        *[c for c in events.columns if c != "pollutants"], *[F.col("pollutants")[n].alias(n) for n in names]
    )


def sendable(events: DataFrame):
    """Both required fields are there."""
    return F.col("timestamp").isNotNull() & F.col("aqi").isNotNull()


def encode_and_route_events(events: DataFrame, prefix: str) -> DataFrame:
    """``topic, key, value``: one topic per city, the event as JSON with its city. Incomplete events are left out."""
    body = F.struct(*[F.col(c) for c in events.columns])
    return events.where(sendable(events)).select(
        F.concat(F.lit(prefix), F.lit("_"), F.lower("city")).alias("topic"),
        F.col("city").alias("key"),
        F.to_json(body).alias("value"),
    )


def write_messages(routed: DataFrame, fmt: str = "kafka", **options) -> None:
    """Send a batch of routed messages. File formats get one folder per topic."""
    writer = routed.write.format(fmt)
    if fmt in ("json", "parquet"):
        writer.mode("append").partitionBy("topic").save(options["path"])
    else:
        writer.options(**options).save()


def route_counts(events: DataFrame) -> DataFrame:
    """``city, sent, failed`` of a batch."""
    good = sendable(events)
    return events.groupBy("city").agg(F.count_if(good).alias("sent"), F.count_if(~good).alias("failed"))
