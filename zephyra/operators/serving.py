"""Queries behind a dashboard, and a fingerprint to compare runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyra.schemas import city_table


def latest_by_city(df: DataFrame, ts: str = "timestamp", tie: str | None = "seq") -> DataFrame:
    """The newest row of every city. Spark limits each city to one row before the shuffle."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie and tie in df.columns else [])
    newest = F.row_number().over(Window.partitionBy("city").orderBy(*order))
    return df.where(F.col(ts).isNotNull()).withColumn("_n", newest).where("_n = 1").drop("_n")


def history(df: DataFrame, cities: list[str], now: Column, days: int = 7, ts: str = "timestamp") -> DataFrame:
    """``city, timestamp, aqi`` of the last ``days`` up to ``now``, in order."""
    start = now.cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    found = df.where(F.col("city").isin(cities) & (F.col(ts) > start) & (F.col(ts) <= now))
    if "date" in df.columns:  # the tables are partitioned by date
        found = found.where((F.col("date") >= F.to_date(start)) & (F.col("date") <= F.to_date(now)))
    return found.select("city", ts, "aqi").orderBy("city", ts)


def city_list(df: DataFrame | None = None, spark=None) -> DataFrame:
    """The cities of a table, or the monitored cities."""
    if df is None:
        return city_table(spark).select("city")
    return df.select("city").distinct()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """``records, fingerprint``: equal for equal rows in any order and partitioning."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("fingerprint"),
    )
