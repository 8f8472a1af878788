"""Per-event features on a stream: one shuffle by city, state in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zephyra.functions.calendar import calendar_parts, season
from zephyra.functions.sliding import HOUR, ROW, SUMMARY, Sliding
from zephyra.schemas import LAG_FEATURES, LAG_OFFSETS, ROLLING_FEATURES, ROLLING_WINDOWS, STREAMING_WINDOW_HOURS
from zephyra.streaming.state import read_state

STATE_COLUMNS = ["buffer_size", "oldest_timestamp", "time_span_hours"]
#: A city that is silent for so long is forgotten; its lags start anew.
FORGET_HOURS = 7 * 24
_KINDS = dict.fromkeys(SUMMARY, "double") | dict.fromkeys(("n", "first_us", "last_us", "last_seq"), "bigint")
SUMMARY_SCHEMA = ", ".join(f"{name} {_KINDS[name]}" for name in SUMMARY)


class StateBuckets:
    """The buckets of a city in the state store. An event reads the rows of the few buckets it looks into."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.summary = handle.getMapState("summary", "bucket bigint", SUMMARY_SCHEMA)
        self.row = handle.getMapState("rows", "bucket bigint", "content binary")
        self.last = handle.getValueState("older", "us bigint, seq bigint, aqi double")

    def summaries(self) -> dict[int, tuple]:
        return {key[0]: tuple(value) for key, value in self.summary.iterator()}

    def rows(self, bucket: int) -> bytes:
        return bytes(self.row.getValue((bucket,))[0])

    def put(self, bucket: int, summary: tuple, rows: bytes) -> None:
        self.summary.updateValue((bucket,), summary)
        self.row.updateValue((bucket,), (rows,))

    def remove(self, bucket: int) -> None:
        self.summary.removeKey((bucket,))
        self.row.removeKey((bucket,))

    def older(self) -> tuple | None:
        return tuple(self.last.get()) if self.last.exists() else None

    def keep_older(self, row: tuple) -> None:
        self.last.update(row)

    def clear(self) -> None:
        self.summary.clear()
        self.row.clear()
        self.last.clear()


class WindowFeatures(StatefulProcessor):
    """Keeps the readings of the last day per city in buckets of time, and the one before them for the longest lag.

    A timer per city drops the day when the watermark has left it behind, and the city when it has been silent for ``forget``.
    """

    def __init__(self, sliding: Sliding, forget: int, output: list[str]):
        self.sliding, self.forget, self.output = sliding, forget, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = StateBuckets(handle)
        self.clock = handle.getValueState("clock", "newest_us bigint, timer_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True).sort_values(["us", "seq"], ignore_index=True)
        points = np.empty(len(fresh), ROW)
        points["us"], points["seq"], points["value"] = fresh["us"], fresh["seq"], fresh["aqi"]
        made = self.sliding.add(self.buckets, points)
        newest, timer = self.clock.get() if self.clock.exists() else (int(points["us"][-1]), None)
        newest = max(newest, int(points["us"][-1]))
        if timer is None:
            timer = self._due(newest, rested=False)
            self.handle.registerTimer(timer)
        self.clock.update((newest, timer))
        yield fresh.assign(**{_column(k): v for k, v in made.items()})[self.output]

    def _due(self, newest: int, rested: bool) -> int:
        """When, in milliseconds, nothing is asked of the buckets any more; and when nothing of the city."""
        day = self.sliding.span * HOUR + self.sliding.lateness
        return -(-(newest + (max(self.forget, day) if rested else day)) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, now = self.clock.get()[0], timerValues.getCurrentWatermarkInMs()
        if self._due(newest, rested=True) <= now:
            self.buckets.clear()
            self.clock.clear()
            return iter(())
        timer = self._due(newest, rested=False)
        if timer <= now:
            self.sliding.rest(self.buckets)
            timer = self._due(newest, rested=True)
        self.handle.registerTimer(timer)
        self.clock.update((newest, timer))
        return iter(())

    def close(self) -> None:
        pass


def _column(name: str) -> str:
    kind, _, hours = name.partition("_")
    return f"aqi_{kind}_{hours}h" if hours.isdigit() else name


def stream_features(
    events: DataFrame,
    watermark: str = "1 hour",
    hours: int = STREAMING_WINDOW_HOURS,
    lateness_us: int = HOUR,
    forget_hours: int = FORGET_HOURS,
    bucket_us: int = HOUR,
) -> DataFrame:
    """Events (``city, timestamp, aqi, seq`` and others) to feature rows, in append mode.

    Rows are in time order within a micro-batch. An event may come late by the watermark; those later still are
    dropped by Spark's watermark and should be sent to quarantine upstream. An event costs the rows of its own bucket of
    time, those of one bucket per offset, and a summary for each other bucket of the day, and only buckets with new rows are
    written; choose ``bucket_us`` (a part of an hour) so that a bucket holds few thousand rows of the busiest city. When the
    watermark has passed a city's last event by the window its readings leave the state, but for the last one; after
    ``forget_hours`` of silence that goes too, and lags of the city start anew. The size of a micro-batch is set at the
    source, which bounds what one city's task holds.
    """
    typed = events.withColumn("seq", F.col("seq").cast("long")).withColumn("aqi", F.col("aqi").cast("double"))
    typed = typed.where("city is not null and timestamp is not null and aqi is not null")
    timed = typed.withWatermark("timestamp", watermark).withColumn("us", F.unix_micros("timestamp"))
    kept = [f for f in timed.schema.fields]
    doubles = [T.StructField(n, T.DoubleType()) for n in (*LAG_FEATURES, *ROLLING_FEATURES)]
    counts = [T.StructField("buffer_size", T.LongType()), T.StructField("oldest_us", T.LongType())]
    schema = T.StructType([*kept, *doubles, *counts])
    sliding = Sliding(tuple(LAG_OFFSETS), tuple(ROLLING_WINDOWS), hours, lateness_us, bucket_us)
    processor = WindowFeatures(sliding, forget_hours * HOUR, schema.fieldNames())
    made = timed.groupBy("city").transformWithStateInPandas(processor, schema, "append", "EventTime")
    oldest = F.timestamp_micros("oldest_us")
    return made.select(
        *[F.nanvl(F.col(f.name), F.lit(None).cast("double")).alias(f.name) if f in doubles else F.col(f.name)
          for f in schema.fields if f.name not in ("us", "oldest_us")],
        oldest.alias("oldest_timestamp"),
        ((F.col("us") - F.col("oldest_us")) / 3.6e9).alias("time_span_hours"),
        *calendar_parts("timestamp"),
        season("timestamp").alias("season"),
    )


def state_readings(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """``city, us, seq, aqi``: the readings that a stream of :func:`stream_features` holds."""
    held = read_state(spark, checkpoint, "rows", operator)
    packed = held.select(F.col("key.city").alias("city"), F.col("user_map_value.content").alias("content"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for city, content in zip(frame["city"], frame["content"], strict=True):
                rows = np.frombuffer(bytes(content), ROW)
                yield pd.DataFrame({"city": city, "us": rows["us"], "seq": rows["seq"], "aqi": rows["value"]})

    return packed.mapInPandas(spread, "city string, us bigint, seq bigint, aqi double")


def state_stats(spark: SparkSession, checkpoint: str, hours: int = STREAMING_WINDOW_HOURS, operator: int = 0) -> DataFrame:
    """``city, buffer_size, oldest_timestamp, newest_timestamp, time_span_hours`` of every city that a stream of
    :func:`stream_features` holds readings of: the window of ``hours`` that ends with the city's last reading."""
    rows = state_readings(spark, checkpoint, operator)
    newest = read_state(spark, checkpoint, "clock", operator).select(
        F.col("key.city").alias("city"), F.col("value.newest_us").alias("newest")
    )
    held = rows.join(newest, "city").where(F.col("us") > F.col("newest") - hours * HOUR)
    found = held.groupBy("city", "newest").agg(F.count("*").alias("buffer_size"), F.min("us").alias("oldest"))
    return found.select(
        "city",
        "buffer_size",
        F.timestamp_micros("oldest").alias("oldest_timestamp"),
        F.timestamp_micros("newest").alias("newest_timestamp"),
        ((F.col("newest") - F.col("oldest")) / 3.6e9).alias("time_span_hours"),
    )
