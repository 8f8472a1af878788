"""Feature engineering: row lags, rolling windows, as-of lags, calendar, season, gap filling, the gold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from zephyra.functions.calendar import calendar_parts, season
from zephyra.functions.columns import numeric_columns
from zephyra.plans.hours import add_trailing, largest_hour, trailing
from zephyra.plans.ordered import (
    ROWS_PER_TASK,
    chunk_rows,
    chunk_windows,
    fill_chunks,
    fill_forward_then_back,
    row_windows,
)
from zephyra.schemas import LAG_OFFSETS, POLLUTANTS, ROLLING_WINDOWS, STREAMING_WINDOW_HOURS


def _lags(window: WindowSpec, column: str, offsets: list[int]) -> list[Column]:
    return [F.lag(column, n).over(window).alias(f"{column}_lag_{n}h") for n in offsets]


def _rolling(window: WindowSpec, column: str, sizes: list[int]) -> list[Column]:
    made = []
    for n in sizes:
        frame = window.rowsBetween(1 - n, 0)
        made += [
            F.avg(column).over(frame).alias(f"{column}_mean_{n}h"),
            F.stddev_samp(column).over(frame).alias(f"{column}_std_{n}h"),
            F.min(column).over(frame).alias(f"{column}_min_{n}h"),
            F.max(column).over(frame).alias(f"{column}_max_{n}h"),
        ]
    return made


def _order(df: DataFrame, ts: str, tie: str | None) -> list[str]:
    return [ts, tie] if tie and tie in df.columns else [ts]


def lag_rows(
    df: DataFrame,
    column: str = "aqi",
    offsets: list[int] = LAG_OFFSETS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str | None = "seq",
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add ``<column>_lag_<n>h``: the value ``n`` rows before."""
    make = lambda w: _lags(w, column, offsets)
    return row_windows(df, list(keys), _order(df, ts, tie), make, max(offsets), limit, bound)


def rolling_rows(
    df: DataFrame,
    column: str = "aqi",
    sizes: list[int] = ROLLING_WINDOWS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str | None = "seq",
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add mean, sample deviation, minimum and maximum over the last ``n`` rows with the current one."""
    make = lambda w: _rolling(w, column, sizes)
    return row_windows(df, list(keys), _order(df, ts, tie), make, max(sizes) - 1, limit, bound)


def _with_trailing(df, keys, ts, column, tie, lags, sizes, closed, std, limit) -> DataFrame:
    top = largest_hour(df, keys, ts)
    found = trailing(df, keys, ts, column, tie, lags, sizes, closed, std, limit, top)
    names = [F.col(f"lag_{n}").alias(f"{column}_lag_{n}h") for n in lags]
    names += [F.col(f"{s}_{n}").alias(f"{column}_{s}_{n}h") for n in sizes for s in ("mean", "std", "min", "max")]
    return add_trailing(df, keys, ts, tie, found, *names, limit=limit, top=top)


def rolling_range(
    df: DataFrame,
    column: str = "aqi",
    sizes: list[int] = ROLLING_WINDOWS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str = "seq",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """The columns of :func:`rolling_rows` over the time range ``[t - n hours, t]``."""
    return _with_trailing(df, list(keys), ts, column, tie, [], sizes, "both", "samp", limit)


def asof_lags(
    df: DataFrame,
    column: str = "aqi",
    offsets: list[int] = LAG_OFFSETS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str = "seq",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``<column>_lag_<n>h``: the latest known value at or before ``t - n hours``, however old."""
    return _with_trailing(df, list(keys), ts, column, tie, offsets, [], "neither", "pop", limit)


def trailing_stats(
    df: DataFrame,
    column: str = "aqi",
    sizes: list[int] = ROLLING_WINDOWS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str = "seq",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Mean, population deviation, minimum and maximum over the open range ``(t - n hours, t)``."""
    return _with_trailing(df, list(keys), ts, column, tie, [], sizes, "neither", "pop", limit)


def event_features(
    df: DataFrame,
    column: str = "aqi",
    offsets: list[int] = LAG_OFFSETS,
    sizes: list[int] = ROLLING_WINDOWS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str = "seq",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """The features a stream computes per event, for a table: as-of lags, trailing statistics, calendar, season."""
    made = _with_trailing(df, list(keys), ts, column, tie, offsets, sizes, "neither", "pop", limit)
    return made.select("*", *calendar_parts(ts), season(ts).alias("season"))


def window_state_stats(
    df: DataFrame,
    hours: int = STREAMING_WINDOW_HOURS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str = "seq",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """What a sliding buffer of ``hours`` holds after each instant: size, oldest and newest stamp, span in hours."""
    keys = list(keys)
    stamped = df.select(*keys, ts, tie, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_stamp"))
    held = trailing(stamped, keys, ts, "_stamp", tie, [], [hours], "right", limit=limit)
    oldest = F.col(f"min_{hours}").cast("long")
    known = [F.when(~F.col(f"_z{i}"), F.col(f"_k{i}")).alias(name) for i, name in enumerate(keys)]
    return held.select(
        *known,
        F.timestamp_micros("_us").alias(ts),
        F.col(f"count_{hours}").alias("buffer_size"),
        F.timestamp_micros(oldest).alias("oldest_timestamp"),
        F.timestamp_micros("_us").alias("newest_timestamp"),
        ((F.col("_us") - oldest) / 3.6e9).alias("time_span_hours"),
    )


def temporal_parts(df: DataFrame, ts: str = "timestamp", week: str = "monday") -> DataFrame:
    """Add ``hour_of_day, day_of_week, month, is_weekend``."""
    return df.select("*", *calendar_parts(ts, week))


def add_season(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add ``season``."""
    return df.withColumn("season", season(ts))


def prior_features(
    df: DataFrame,
    column: str = "aqi",
    offsets: list[int] = LAG_OFFSETS,
    sizes: list[int] = ROLLING_WINDOWS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str | None = "seq",
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Features of a row that know only the rows before it: row lags, statistics over the ``n`` rows up to the previous
    one, calendar. A model on them can forecast."""

    def make(window: WindowSpec) -> list[Column]:
        made = _lags(window, column, offsets)
        for n in sizes:
            frame = window.rowsBetween(-n, -1)
            made += [
                F.avg(column).over(frame).alias(f"{column}_mean_{n}h"),
                F.stddev_samp(column).over(frame).alias(f"{column}_std_{n}h"),
                F.min(column).over(frame).alias(f"{column}_min_{n}h"),
                F.max(column).over(frame).alias(f"{column}_max_{n}h"),
            ]
        return made

    made = row_windows(df, list(keys), _order(df, ts, tie), make, max([*offsets, *sizes]), limit, bound)
    return made.select("*", *calendar_parts(ts), season(ts).alias("season"))


def source_columns(df: DataFrame) -> list[str]:
    """The measured columns, as opposed to derived ones."""
    return [c for c in ["aqi", *POLLUTANTS] if c in df.columns]


def fill_missing(
    df: DataFrame,
    columns: list[str] | None = None,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str | None = "seq",
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Per key: last known value, before the first one that value, and 0 for numbers of a key without any.

    The measured columns are filled unless others are named. Filling lag columns backwards would show later rows to
    earlier ones, so it has to be asked for.
    """
    columns = columns or source_columns(df)
    return fill_forward_then_back(
        df, list(keys), _order(df, ts, tie), columns, _zero(df, columns), limit, bound
    )


def _zero(df: DataFrame, columns: list[str]) -> dict[str, object]:
    numeric = set(numeric_columns(df))
    return {c: 0.0 for c in columns if c in numeric}


def build_gold(
    df: DataFrame,
    column: str = "aqi",
    offsets: list[int] = LAG_OFFSETS,
    sizes: list[int] = ROLLING_WINDOWS,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str | None = "seq",
    mode: str = "rows",
    fill: bool = True,
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Silver to gold: lags, rolling statistics, calendar, season, then gaps of the measured columns filled.

    ``mode="rows"`` counts rows and ``mode="range"`` counts hours (row lags stay row lags). Features see the values
    before filling.
    """
    if mode not in ("rows", "range"):
        raise ValueError(f"unknown mode: {mode}")
    keys, order = list(keys), _order(df, ts, tie)
    reach = max(offsets) if mode == "range" else max([*offsets, *[n - 1 for n in sizes]])
    limit = max(limit, reach)
    calendar = [*calendar_parts(ts), season(ts).alias("season")]
    columns = source_columns(df)

    def make(window: WindowSpec) -> list[Column]:
        return _lags(window, column, offsets) + (_rolling(window, column, sizes) if mode == "rows" else [])

    chunks = chunk_rows(df, keys, order, limit, bound)
    if chunks is None:
        made = df.select("*", *make(Window.partitionBy(*keys).orderBy(*order)))
    else:  # one cut of the table serves the windows and the filling
        made = chunk_windows(chunks, keys, make, reach, limit)
    if mode == "range":
        made = rolling_range(made, column, sizes, keys, ts, tie, limit)
    made = made.select("*", *calendar)
    if not fill:
        return made.drop("_row", "_chunk")
    if chunks is None:  # the size of the keys is known by now
        return fill_forward_then_back(made, keys, order, columns, _zero(df, columns), limit=None)
    return fill_chunks(made, chunks, keys, columns, _zero(df, columns)).drop("_row", "_chunk")
