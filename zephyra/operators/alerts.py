"""Alert rules, and suppression of repeats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyra.functions.bands import category, category_attribute, prediction_advice, prediction_level
from zephyra.functions.columns import need_columns
from zephyra.functions.rounding import fixed_text
from zephyra.functions.spacing import entered, exits, followed, passing
from zephyra.plans.ordered import chunk_rows, join_on
from zephyra.plans.tables import write_out
from zephyra.schemas import ALERT_WINDOW_HOURS, PREDICTION_THRESHOLD

INSTANTS_PER_TASK = 500_000  # of one key, as numbers in a Python worker


def alert_id() -> Column:
    """The same alert gets the same id on every run."""
    return F.sha2(
        F.concat_ws("|", "alert_type", "city", "level", F.unix_micros(F.col("timestamp").cast("timestamp"))), 256
    )


def rule_alerts(readings: DataFrame, mode: str = "strict", value: str = "aqi") -> DataFrame:
    """An alert for every reading above the lowest band. Works on tables and streams."""
    need_columns(readings, "city", "timestamp", value)
    name = F.col("category")
    found = readings.withColumn("category", category(F.col(value), mode)).where(
        name.isNotNull() & (category_attribute(name, "alert_level") != "none")
    )
    keep = [c for c in ("seq",) if c in readings.columns]
    alerts = found.select(
        *keep,
        F.lit("rule_based").alias("alert_type"),
        "city",
        "category",
        category_attribute(name, "alert_level").alias("level"),
        F.col(value).alias("current_aqi"),
        "timestamp",
        F.format_string("%s: AQI %s (%s)", F.col("city"), fixed_text(F.col(value), 1), name).alias("message"),
        category_attribute(name, "recommendation").alias("recommendation"),
        category_attribute(name, "threshold_min").alias("threshold_min"),
        category_attribute(name, "threshold_max").alias("threshold_max"),
    )
    return alerts.withColumn("alert_id", alert_id())


def _check_threshold(threshold: float) -> None:
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
        raise ValueError(f"the threshold must be a number, not {type(threshold).__name__}")
    if threshold < 0:
        raise ValueError("the threshold must not be negative")


def model_alerts(predictions: DataFrame, threshold: float = PREDICTION_THRESHOLD) -> DataFrame:
    """An alert for every prediction strictly above the threshold. Works on tables and streams."""
    _check_threshold(threshold)
    need_columns(predictions, "city", "timestamp", "predicted_aqi")
    predicted = F.col("predicted_aqi")
    current = F.col("current_aqi") if "current_aqi" in predictions.columns else F.lit(None).cast("double")
    keep = [c for c in ("seq",) if c in predictions.columns]
    alerts = predictions.where(predicted > threshold).select(
        *keep,
        F.lit("model_based").alias("alert_type"),
        "city",
        prediction_level(predicted).alias("level"),
        current.alias("current_aqi"),
        "predicted_aqi",
        "timestamp",
        F.format_string(
            f"%s: Predicted AQI %s exceeds threshold ({threshold})", F.col("city"), fixed_text(predicted, 1)
        ).alias("message"),
        F.lit(float(threshold)).alias("threshold"),
        prediction_advice(predicted).alias("recommendation"),
    )
    return alerts.withColumn("alert_id", alert_id())


def alert_preview(predictions: DataFrame, threshold: float = PREDICTION_THRESHOLD) -> DataFrame:
    """What :func:`model_alerts` would do with every prediction."""
    _check_threshold(threshold)
    predicted = F.col("predicted_aqi")
    keep = [c for c in ("seq", "city", "timestamp") if c in predictions.columns]
    return predictions.select(
        *keep,
        "predicted_aqi",
        F.lit(float(threshold)).alias("threshold"),
        (predicted > threshold).alias("will_trigger_alert"),
        prediction_level(predicted).alias("alert_level"),
        prediction_advice(predicted).alias("recommendation"),
    )


def check_window(hours: int) -> int:
    """The suppression window in microseconds."""
    if isinstance(hours, bool) or not isinstance(hours, int) or hours <= 0:
        raise ValueError("the window must be a positive number of whole hours")
    return hours * 3_600_000_000


def suppress_repeats(
    alerts: DataFrame,
    hours: int = ALERT_WINDOW_HOURS,
    include_type: bool = False,
    tie: str = "seq",
    limit: int = INSTANTS_PER_TASK,
) -> DataFrame:
    """The alerts that are sent: the first of its ``(city, level)``, then each one at least ``hours`` after the last
    one *sent*. Suppressed alerts do not restart the clock. Of several at one instant the lowest ``tie`` counts.

    Whether an alert is sent depends on all before it, so this is a scan along time. It runs over instants (one number
    per key and distinct stamp, combined before the shuffle). A key with more than ``limit`` instants is cut into
    chunks: each chunk works out how it maps the last sent stamp before it to the last one in it, those small maps are
    chained per key, and then every chunk marks its own alerts.
    """
    window = check_window(hours)
    need_columns(alerts, "city", "level", "timestamp", tie)
    keys = ["city", "level", *(["alert_type"] if include_type else [])]
    stamped = alerts.withColumn("_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    instants = stamped.groupBy(*keys, "_us").agg(F.min(tie).alias(tie))
    sent = _sent(instants, keys, window, limit, alerts)
    same = F.lit(True)
    for name in (*keys, "_us", tie):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"s.{name}"))
    return stamped.alias("a").join(sent.alias("s"), same, "left_semi").drop("_us")


def _sent(instants: DataFrame, keys: list[str], window: int, limit: int, bound: DataFrame) -> DataFrame:
    columns = instants.columns
    chunks = chunk_rows(instants, keys, ["_us"], limit, bound)
    if chunks is None:
        marked = instants.withColumn("_last", F.lit(None).cast("long"))
        group = keys
    else:
        group = [*keys, "_chunk"]
        marked = join_on(chunks.drop("_row"), _entries(chunks, keys, window), group)

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_us", ignore_index=True)
        last = rows["_last"].iloc[0]
        mask = passing(rows["_us"].to_numpy(), window, None if pd.isna(last) else int(last))
        return rows.loc[mask, columns]

    return marked.groupBy(*group).applyInPandas(mark, instants.schema)


def _entries(chunks: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Per chunk, the last sent stamp before it.

    The map of a chunk takes the last stamp before it to the last one in it. Neighbouring maps are joined pairwise, level by
    level, up to one for each key; then the stamps before go down the same levels. No task holds more than two maps.
    """
    group = [*keys, "_chunk"]
    fields = chunks.select(*group).schema.simpleString()[len("struct<") : -1]
    shape = f"{fields}, _upto array<bigint>, _exit array<bigint>"

    def map_of_chunk(rows: pd.DataFrame) -> pd.DataFrame:
        upto, end = exits(np.sort(rows["_us"].to_numpy()), window)
        return rows[group].iloc[[0]].assign(_upto=[upto], _exit=[end])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_chunk", ignore_index=True)
        upto, end = rows["_upto"].iloc[0], rows["_exit"].iloc[0]
        if len(rows) > 1:
            upto, end = followed(upto, end, rows["_upto"].iloc[1], rows["_exit"].iloc[1], window)
        return rows[keys].iloc[[0]].assign(_chunk=rows["_parent"].iloc[0], _upto=[upto], _exit=[end])[[*group, "_upto", "_exit"]]

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_chunk", ignore_index=True)
        last = None if pd.isna(rows["_last"].iloc[0]) else int(rows["_last"].iloc[0])
        lasts = [last]
        if len(rows) > 1:
            lasts.append(entered(rows["_upto"].iloc[0], rows["_exit"].iloc[0], window, last))
        return rows[group].assign(_last=pd.array(lasts, dtype="Int64"))

    parent = F.shiftright("_chunk", 1).alias("_parent")
    levels = [write_out(chunks.groupBy(*group).applyInPandas(map_of_chunk, shape))]
    most = levels[0].agg(F.max("_chunk")).first()[0] or 0
    while most > 0:
        joined = levels[-1].select("*", parent).groupBy(*keys, "_parent").applyInPandas(together, shape)
        levels.append(write_out(joined))
        most >>= 1
    lasts = levels.pop().select(*group, F.lit(None).cast("long").alias("_last"))
    while levels:
        above = lasts.withColumnRenamed("_chunk", "_parent")
        rows = join_on(levels.pop().select("*", parent), above, [*keys, "_parent"])
        lasts = write_out(rows.groupBy(*keys, "_parent").applyInPandas(down, f"{fields}, _last bigint"))
    return lasts


def suppression_state(sent: DataFrame, now: Column, hours: int = ALERT_WINDOW_HOURS) -> DataFrame:
    """``city, level, last_sent, seconds_until_next, expired`` from the alerts that were sent."""
    window = check_window(hours) / 1e6
    state = sent.groupBy("city", "level").agg(F.max("timestamp").alias("last_sent"))
    since = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_sent").cast("timestamp"))) / 1e6
    return state.select(
        "city",
        "level",
        "last_sent",
        F.greatest(F.lit(0.0), F.lit(window) - since).alias("seconds_until_next"),
        (since > window).alias("expired"),
    )


def suppression_totals(state: DataFrame, hours: int = ALERT_WINDOW_HOURS) -> DataFrame:
    """``dedup_window_hours, total_entries, unique_cities, unique_levels`` of a :func:`suppression_state`."""
    return state.agg(
        F.lit(hours).alias("dedup_window_hours"),
        F.count("*").alias("total_entries"),
        F.count_distinct("city").alias("unique_cities"),
        F.count_distinct("level").alias("unique_levels"),
    )


def alert_flow(
    results: DataFrame,
    threshold: float = PREDICTION_THRESHOLD,
    hours: int = ALERT_WINDOW_HOURS,
    mode: str = "strict",
    limit: int = INSTANTS_PER_TASK,
) -> DataFrame:
    """Readings with predictions to sent alerts: rule and model alerts, then repeats suppressed across both.

    The rule alert of a row comes before its model alert.
    """
    need_columns(results, "city", "timestamp", "current_aqi", "predicted_aqi", "seq")
    rules = rule_alerts(results, mode, "current_aqi").withColumn("seq", F.col("seq") * 2)
    models = model_alerts(results, threshold).withColumn("seq", F.col("seq") * 2 + 1)
    return suppress_repeats(rules.unionByName(models, allowMissingColumns=True), hours, limit=limit)
