"""Suppression of repeated alerts on a stream: the last sent stamp per city and level is the whole state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zephyra.functions.spacing import passing
from zephyra.operators.alerts import check_window
from zephyra.schemas import ALERT_WINDOW_HOURS
from zephyra.streaming.state import read_state


class LastSent(StatefulProcessor):
    """``last`` is the stamp of the last alert that was sent. With ``expire`` a timer removes it when the watermark has passed
    it by the window: from then on every alert that still arrives is sent, as it is without an entry."""

    def __init__(self, window_us: int, output: list[str], expire: bool):
        self.window, self.output, self.expire = window_us, output, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["stamp_us", "seq"], ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        mask = passing(batch["stamp_us"].to_numpy(), self.window, last)
        if mask.any():
            now = int(batch.loc[mask, "stamp_us"].iloc[-1])
            self.last.update((now,))
            if self.expire and last is None:  # else a timer is waiting already
                self.handle.registerTimer(self._due(now))
        yield batch.loc[mask, self.output]

    def _due(self, last: int) -> int:
        return -(-(last + self.window) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._due(self.last.get()[0])
        if due <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        else:
            self.handle.registerTimer(due)
        return iter(())

    def close(self) -> None:
        pass


def suppress_repeats_stream(
    alerts: DataFrame, hours: int = ALERT_WINDOW_HOURS, include_type: bool = False, watermark: str | None = "1 hour"
) -> DataFrame:
    """The streaming form of ``suppress_repeats``: event time, alerts in time order within a micro-batch.

    Entries leave the state when the watermark has passed them by the window. Without ``watermark`` they stay.
    """
    window = check_window(hours)
    if watermark:
        alerts = alerts.withWatermark("timestamp", watermark)
    stamped = alerts.withColumn("stamp_us", F.unix_micros("timestamp"))
    keys = ["city", "level", *(["alert_type"] if include_type else [])]
    processor = LastSent(window, stamped.columns, bool(watermark))
    mode = "EventTime" if watermark else "None"
    sent = stamped.groupBy(*keys).transformWithStateInPandas(processor, stamped.schema, "append", mode)
    return sent.drop("stamp_us")


def state_entries(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """``city, level, last_sent``: the entries that a stream of :func:`suppress_repeats_stream` holds."""
    held = read_state(spark, checkpoint, "last", operator)
    return held.select("key.city", "key.level", F.timestamp_micros("value.us").alias("last_sent"))
