"""Data quality: counts, score, alerts, recommendations and profiles."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyra.functions.columns import natural_key, tidy
from zephyra.functions.rounding import round_half_even
from zephyra.schemas import AQI_MAX, AQI_MIN, CRITICAL_FIELDS, RUN_TARGET_SECONDS


def _null(column: str) -> Column:
    return F.count_if(F.col(column).isNull()).alias(column)


def missing_by_column(df: DataFrame) -> DataFrame:
    """``column, missing`` for the columns with nulls. One pass."""
    counts = df.agg(*[_null(c) for c in df.columns])
    rows = tidy(counts, df.columns, name="column")
    return rows.select("column", F.col("value").cast("long").alias("missing")).where("missing > 0")


def out_of_range_count(df: DataFrame, column: str = "aqi", low: float = AQI_MIN, high: float = AQI_MAX) -> DataFrame:
    """``column, out_of_range``."""
    outside = F.count_if(~F.col(column).between(low, high))
    return df.agg(outside.alias("out_of_range")).select(F.lit(column).alias("column"), "out_of_range")


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``duplicates``: rows beyond the first of their key. Null keys are equal to each other."""
    groups = df.groupBy(*(keys or natural_key(df))).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def quality_summary(df: DataFrame, keys: list[str] | None = None, mode: str = "sum") -> DataFrame:
    """One row of counts and the score.

    The table is grouped by key once; rows are pre-aggregated before the shuffle and everything else is summed over
    the groups. With ``mode="sum"`` a row counts once per failing check, so the score can be negative. With
    ``mode="rows"`` every row counts once, except one complete, in-range row per key.
    """
    if mode not in ("sum", "rows"):
        raise ValueError(f"unknown mode: {mode}")
    keys = keys or natural_key(df)
    outside = ~F.col("aqi").between(AQI_MIN, AQI_MAX)
    critical = [c for c in CRITICAL_FIELDS if c in df.columns]
    gap = F.coalesce(outside, F.lit(False))
    for c in critical:
        gap = gap | F.col(c).isNull()
    groups = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns],
        F.count_if(outside).alias("_outside"),
        F.count_if(~gap).alias("_good"),
    )
    totals = groups.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_records"),
        *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(f"_null_{c}") for c in df.columns],
        F.coalesce(F.sum("_outside"), F.lit(0)).alias("out_of_range"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicates"),
        # a group with a good row keeps exactly one of its rows
        F.coalesce(F.sum(F.when(F.col("_good") > 0, 1).otherwise(0)), F.lit(0)).alias("_kept"),
    )
    nulls = [F.col(f"_null_{c}") for c in df.columns]
    missing = sum(nulls[1:], nulls[0])
    null_critical = sum([F.col(f"_null_{c}") for c in critical], F.lit(0))
    issues = null_critical + F.col("out_of_range") + F.col("duplicates")
    if mode == "rows":
        issues = F.col("total_records") - F.col("_kept")
    score = F.coalesce(F.try_divide((F.col("total_records") - issues) * 100.0, "total_records"), F.lit(0.0))
    return totals.select(
        "total_records",
        missing.alias("missing_values"),
        sum((F.when(n > 0, 1).otherwise(0) for n in nulls), F.lit(0)).cast("long").alias("missing_columns"),
        "out_of_range",
        "duplicates",
        issues.alias("issues"),
        round_half_even(score, 2).alias("quality_score"),
    )


def quality_score(df: DataFrame, keys: list[str] | None = None, mode: str = "sum") -> DataFrame:
    """``total_records, issues, quality_score``."""
    return quality_summary(df, keys, mode).select("total_records", "issues", "quality_score")


def _message(condition: Column, level: str, message: Column) -> Column:
    return F.when(condition, F.struct(F.lit(level).alias("level"), message.alias("message")))


def quality_alerts(summary: DataFrame) -> DataFrame:
    """``level, message`` for every failing check of a :func:`quality_summary`."""
    filled = F.col("total_records") > 0
    # fixed values: levels and message formats
    checks = [
        _message(~filled, "critical", F.lit("Empty DataFrame provided for validation")),
        _message(
            filled & (F.col("quality_score") < 80),
            "warning",
            F.format_string("Quality score below 80%%: %.2f%%", "quality_score"),
        ),
        _message(
            F.col("missing_values") > 0,
            "warning",
            F.format_string("Found %d missing values in %d columns", "missing_values", "missing_columns"),
        ),
        _message(F.col("out_of_range") > 0, "warning", F.format_string("Found %d out-of-range values", "out_of_range")),
        _message(F.col("duplicates") > 0, "info", F.format_string("Found %d duplicate records", "duplicates")),
    ]
    return summary.select(F.inline(F.array_compact(F.array(*checks))))


def quality_recommendations(summary: DataFrame) -> DataFrame:
    """``position, recommendation``: fixed advice per failing check, or that all is good."""
    # fixed values: the texts
    advice = F.array_compact(
        F.array(
            F.when(
                F.col("quality_score") < 80,
                "Quality score is below 80%. Consider investigating data sources and validation rules.",
            ),
            F.when(
                F.col("missing_values") > 0,
                F.format_string(
                    "Address missing values in %d columns. Consider imputation or data source verification.",
                    "missing_columns",
                ),
            ),
            F.when(
                F.col("out_of_range") > 0,
                "Out-of-range values detected. Verify data source and validation thresholds.",
            ),
            F.when(
                F.col("duplicates") > 0, "Duplicate records detected. Implement deduplication in ETL pipeline."
            ),
        )
    )
    good = F.array(F.lit("Data quality is good. Continue monitoring."))
    return summary.select(
        F.posexplode(F.when(F.size(advice) > 0, advice).otherwise(good)).alias("position", "recommendation")
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, missing, missing_pct, distinct, type`` per column.

    ``approximate`` swaps the exact distinct count, which shuffles every value once per column, for a sketch.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    types = dict(df.dtypes)
    measured = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns],
        *[count(F.col(c)).alias(f"_distinct_{c}") for c in df.columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_null_{c}").alias("missing"),
                F.coalesce(F.try_divide(F.col(f"_null_{c}") * 100.0, "_rows"), F.lit(0.0)).alias("missing_pct"),
                F.col(f"_distinct_{c}").alias("distinct"),
                F.lit(types[c]).alias("type"),
            )
            for c in df.columns
        ]
    )
    return measured.select(F.inline(rows))


def group_profile(df: DataFrame, key: str = "city", value: str = "aqi") -> DataFrame:
    """Per key: rows, missing values, lowest and highest value."""
    return df.groupBy(key).agg(
        F.count("*").alias("records"),
        F.count_if(F.col(value).isNull()).alias(f"missing_{value}"),
        F.min(value).alias(f"min_{value}"),
        F.max(value).alias(f"max_{value}"),
    )


def quality_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All checks in one tidy table: ``section, item, measure, value, text``."""

    def rows(part: DataFrame, section: str, item: Column, measures: list[str], text: Column | None = None) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        text = F.lit(None).cast("string") if text is None else text
        return part.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs), text.alias("text"))

    summary = quality_summary(df, keys)
    measures = ["total_records", "quality_score", "missing_values", "out_of_range", "duplicates"]
    one = F.lit(1).alias("value")
    parts = [
        rows(summary, "summary", F.lit("table"), measures),
        rows(column_profile(df), "column", F.col("column"), ["missing", "missing_pct", "distinct"], F.col("type")),
        rows(quality_alerts(summary).select("*", one), "alert", F.col("level"), ["value"], F.col("message")),
        rows(
            quality_recommendations(summary).select("*", one),
            "recommendation",
            F.col("position").cast("string"),
            ["value"],
            F.col("recommendation"),
        ),
    ]
    if "city" in df.columns:
        parts.append(rows(group_profile(df), "city", F.col("city"), ["records", "missing_aqi", "min_aqi", "max_aqi"]))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


class RunMetrics:
    """Stage times and record counts of one pipeline run, as rows."""

    def __init__(self, run_id: str):
        self.run_id = run_id
        self.seconds: dict[str, float] = {}
        self.values: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        start = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - start

    def table(self, spark) -> DataFrame:
        """``run_id, operation, seconds, measure, value``."""
        total = sum(self.seconds.values())
        rows = [(self.run_id, name, seconds, None, None) for name, seconds in self.seconds.items()]
        rows.append((self.run_id, "total", total, None, None))
        values = {**self.values, "within_target": float(total < RUN_TARGET_SECONDS)}
        rows += [(self.run_id, None, None, name, float(value)) for name, value in values.items()]
        return spark.createDataFrame(
            rows, "run_id string, operation string, seconds double, measure string, value double"
        )
