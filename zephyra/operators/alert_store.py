"""The alert table: two append-only Parquet tables, ``alerts`` by date and ``acknowledgements``.

An acknowledgement is a row of its own, so writers only ever append, and the state of an alert is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyra.functions.columns import need_columns
from zephyra.operators.alerts import alert_id
from zephyra.schemas import ALERT

REQUIRED = ["alert_type", "city", "level", "timestamp"]


def stored_form(alerts: DataFrame) -> DataFrame:
    """The columns that are kept, with an id where there is none. Band bounds are not kept."""
    need_columns(alerts, *REQUIRED)
    if "alert_id" not in alerts.columns:
        alerts = alerts.withColumn("alert_id", alert_id())
    else:
        alerts = alerts.withColumn("alert_id", F.coalesce("alert_id", alert_id()))
    present = set(alerts.columns)

    def column(field) -> Column:
        if field.name in present:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        if field.name == "created_at":
            return F.current_timestamp().alias("created_at")
        return F.lit(None).cast(field.dataType).alias(field.name)

    return alerts.select(*map(column, ALERT.fields))


def store_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Store, partitioned by date. Rows lacking a required value stay out; see :func:`unstorable`."""
    complete = stored_form(alerts).dropna(subset=REQUIRED)
    dated = complete.withColumn("date", F.to_date("timestamp"))
    dated.sortWithinPartitions("date", "city", "level").write.mode(mode).partitionBy("date").parquet(path)


def unstorable(alerts: DataFrame) -> DataFrame:
    """The rows :func:`store_alerts` leaves out."""
    condition = F.lit(False)
    for name in REQUIRED:
        condition = condition | F.col(name).isNull()
    return alerts.where(condition)


def read_alerts(spark, path: str) -> DataFrame:
    from zephyra.sources.tables import read_or_empty

    # a stream stores each micro-batch in a folder of its own
    return read_or_empty(spark, path, ALERT, "batch", "date").drop("batch")


def get_alert(alerts: DataFrame, wanted: str) -> DataFrame:
    """The alert with this id."""
    return alerts.where(F.col("alert_id") == wanted)


def _newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("timestamp").desc(), "alert_id")


def with_acknowledgement(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Add ``acknowledged, acknowledged_at, acknowledged_by``; of several acknowledgements the last one counts."""
    last = acks.groupBy("alert_id").agg(
        F.max(F.struct("acknowledged_at", "acknowledged_by")).alias("_ack"),
    )
    joined = alerts.join(last, "alert_id", "left")
    return joined.select(
        *alerts.columns,
        F.col("_ack").isNotNull().alias("acknowledged"),
        F.col("_ack.acknowledged_at").alias("acknowledged_at"),
        F.col("_ack.acknowledged_by").alias("acknowledged_by"),
    )


def active_alerts(alerts: DataFrame, acks: DataFrame, city: str | None = None, level: str | None = None) -> DataFrame:
    """Alerts without an acknowledgement, newest first."""
    if city is not None:
        alerts = alerts.where(F.col("city") == city)
    if level is not None:
        alerts = alerts.where(F.col("level") == level)
    return _newest_first(alerts.join(acks, "alert_id", "left_anti"))


def _since(alerts: DataFrame, now: Column, hours: int) -> DataFrame:
    start = now.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    recent = alerts.where(F.col("timestamp") > start)
    return recent.where(F.col("date") >= F.to_date(start)) if "date" in alerts.columns else recent


def alerts_by_city(
    alerts: DataFrame, acks: DataFrame, city: str, now: Column, hours: int = 24, acknowledged: bool | None = None
) -> DataFrame:
    """Alerts of a city after ``now - hours``, newest first; ``acknowledged`` filters on the flag."""
    found = with_acknowledgement(_since(alerts, now, hours).where(F.col("city") == city), acks)
    if acknowledged is not None:
        found = found.where(F.col("acknowledged") == acknowledged)
    return _newest_first(found)


def alerts_by_level(alerts: DataFrame, level: str, now: Column, hours: int = 24) -> DataFrame:
    """Alerts of a level after ``now - hours``, newest first."""
    return _newest_first(_since(alerts, now, hours).where(F.col("level") == level))


def acknowledgements(alerts: DataFrame, ids: DataFrame, by: str | None, at: Column | None = None) -> DataFrame:
    """Rows to append for those ``ids`` (column ``alert_id``) that name an alert; unknown ids make none."""
    known = ids.select("alert_id").distinct().join(alerts, "alert_id", "left_semi")
    at = F.current_timestamp() if at is None else at
    return known.select(
        "alert_id", at.cast("timestamp").alias("acknowledged_at"), F.lit(by).cast("string").alias("acknowledged_by")
    )


def store_acknowledgements(acks: DataFrame, path: str) -> None:
    acks.write.mode("append").parquet(path)


def read_acknowledgements(spark, path: str) -> DataFrame:
    from zephyra.schemas import ACKNOWLEDGEMENT
    from zephyra.sources.tables import read_or_empty

    return read_or_empty(spark, path, ACKNOWLEDGEMENT)


def alert_stats(alerts: DataFrame, acks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """``grouping, city, level, total_alerts, active_alerts`` overall, by level and by city, in one pass."""
    flagged = with_acknowledgement(_since(alerts, now, hours), acks)
    sets = flagged.groupingSets([[], ["level"], ["city"]], "level", "city").agg(
        F.grouping_id("level", "city").alias("_g"),
        F.count("*").alias("total_alerts"),
        F.count_if(~F.col("acknowledged")).alias("active_alerts"),
    )
    name = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "level").otherwise("city")
    return sets.select(name.alias("grouping"), "city", "level", "total_alerts", "active_alerts")
