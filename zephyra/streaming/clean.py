"""Cleaning on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deduplicate_stream(events: DataFrame, keys: tuple[str, ...] = ("city", "timestamp"), watermark: str = "1 day") -> DataFrame:
    """The first event of each key that arrives. State of a key is dropped when the watermark has passed it, so copies that
    come later than ``watermark`` after the newest event are not known any more; which copy stays follows arrival."""
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(list(keys))
