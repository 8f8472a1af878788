"""Calendar columns of a timestamp. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyra.schemas import SEASONS


def season(ts: str = "timestamp") -> Column:
    """Season name of the month."""
    month = F.month(ts)
    chain = None
    for name, months in SEASONS.items():
        chain = F.when(month.isin(months), name) if chain is None else chain.when(month.isin(months), name)
    return chain


def calendar_parts(ts: str = "timestamp", week: str = "monday") -> list[Column]:
    """``hour_of_day, day_of_week, month, is_weekend``.

    ``week="monday"`` counts Monday as 0 and takes Saturday and Sunday as the weekend. ``week="sunday"`` counts
    Sunday as 0 and flags days 5 and 6 of that count, which are Friday and Saturday; it is there for tables that
    were built that way.
    """
    if week not in ("monday", "sunday"):
        raise ValueError(f"unknown week start: {week}")
    day = F.weekday(ts) if week == "monday" else F.dayofweek(ts) - 1
    return [
        F.hour(ts).alias("hour_of_day"),
        day.alias("day_of_week"),
        F.month(ts).alias("month"),
        F.when(day >= 5, 1).when(day < 5, 0).alias("is_weekend"),
    ]
