"""Cleaning: schema gate, filters, de-duplication, order check, quality flags, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.functions.bands import category
from zephyra.functions.columns import natural_key, need_columns
from zephyra.plans.ordered import ROWS_PER_TASK, join_on, row_windows, running_max_before
from zephyra.schemas import AQI_MAX, AQI_MIN, CRITICAL_FIELDS, category_table


class SchemaError(ValueError):
    """The input table cannot be landed."""


def schema_gate(df: DataFrame) -> DataFrame:
    """Pass ``df`` on, or raise when columns are missing, have the wrong type, or there are no rows."""
    missing = [name for name in CRITICAL_FIELDS if name not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    if not isinstance(types["timestamp"], (T.TimestampType, T.TimestampNTZType)):
        raise SchemaError("column 'timestamp' must be a timestamp")
    if not isinstance(types["aqi"], T.NumericType):
        raise SchemaError("column 'aqi' must be numeric")
    if not isinstance(types["city"], T.StringType):
        raise SchemaError("column 'city' must be a string")
    if df.isEmpty():
        raise SchemaError("the table is empty")
    return df


def gate_counts(df: DataFrame) -> DataFrame:
    """What the gate reports without rejecting: nulls of the critical fields, values out of range."""
    need_columns(df, *CRITICAL_FIELDS)
    return df.agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in CRITICAL_FIELDS],
        F.count_if(~F.col("aqi").between(AQI_MIN, AQI_MAX)).alias("out_of_range"),
    )


def drop_missing_critical(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows with a value in every critical field."""
    return df.dropna(subset=fields or CRITICAL_FIELDS)


def filter_range(df: DataFrame, column: str = "aqi", low: float = AQI_MIN, high: float = AQI_MAX) -> DataFrame:
    """Rows with ``low <= column <= high``."""
    return df.where(F.col(column).between(low, high))


def deduplicate(df: DataFrame, keys: list[str] | None = None, order: str | None = "seq") -> DataFrame:
    """The first row by ``order`` of every key; without ``order``, any row of the key.

    Spark limits the groups to one row before the shuffle already, so copies never meet in one task.
    """
    keys = keys or natural_key(df)
    if order is None:
        return df.dropDuplicates(keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def mark_out_of_order(
    df: DataFrame,
    keys: list[str] = ("city",),
    order: str = "seq",
    ts: str = "timestamp",
    mode: str = "running",
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add ``late``: the row is earlier than what arrived before it for its key.

    ``running`` compares with the latest stamp so far, ``previous`` with the row just before.
    """
    keys = list(keys)
    if mode == "previous":
        df = row_windows(df, keys, [order], lambda w: [F.lag(ts).over(w).alias("_earlier")], 1, limit, bound)
    elif mode == "running":
        df = running_max_before(df, keys, [order], ts, "_earlier", limit, bound)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn("late", F.coalesce(F.col(ts) < F.col("_earlier"), F.lit(False))).drop("_earlier")


def reject_out_of_order(df: DataFrame, **options) -> DataFrame:
    """Drop the rows that :func:`mark_out_of_order` marks."""
    return mark_out_of_order(df, **options).where(~F.col("late")).drop("late")


def _missing() -> Column:
    condition = F.lit(False)
    for name in CRITICAL_FIELDS:
        condition = condition | F.col(name).isNull()
    return condition


def quality_flags(
    df: DataFrame, keys: list[str] | None = None, order: str = "seq", limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``quality_flags``, an array of ``missing, out_of_range, duplicate, out_of_order``; empty for a good row."""
    keys = keys or natural_key(df)
    rows = df
    # joined on the order as well: a key with very many copies is spread by it
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    df = join_on(df, first, list(dict.fromkeys([*keys, order])))
    df = mark_out_of_order(df, order=order, limit=limit, bound=rows)
    flags = [
        F.when(_missing(), "missing"),
        F.when(~F.col("aqi").between(AQI_MIN, AQI_MAX), "out_of_range"),
        F.when(F.col("_first").isNull(), "duplicate"),
        F.when(F.col("late"), "out_of_order"),
    ]
    return df.withColumn("quality_flags", F.array_compact(F.array(*flags))).drop("_first", "late")


def clean(
    df: DataFrame, keys: list[str] | None = None, order: str = "seq", limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Bronze to silver: de-duplicate, drop incomplete rows, filter the range, reject late rows, add empty flags."""
    kept = filter_range(drop_missing_critical(deduplicate(df, keys, order)))
    kept = reject_out_of_order(kept, order=order, limit=limit, bound=df)
    return kept.withColumn("quality_flags", F.array().cast("array<string>"))


def rejection_counts(
    df: DataFrame, keys: list[str] | None = None, order: str = "seq", limit: int = ROWS_PER_TASK
) -> DataFrame:
    """``reason, records``: rows that each step of :func:`clean` takes away, and the rows that stay (``valid``)."""
    keys = keys or natural_key(df)
    groups = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    copies = groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("records")).select(F.lit("duplicate").alias("reason"), "records")
    first = deduplicate(df, keys, order).select(*dict.fromkeys([*CRITICAL_FIELDS, order]))
    reason = F.when(_missing(), "missing").when(~F.col("aqi").between(AQI_MIN, AQI_MAX), "out_of_range")
    first = first.withColumn("reason", reason)
    # rows that are gone already must not move the running maximum
    seen = F.when(F.col("reason").isNull(), F.col("timestamp"))
    marked = running_max_before(first.withColumn("_seen", seen), ["city"], [order], "_seen", "_earlier", limit, df)
    late = F.col("reason").isNull() & (F.col("timestamp") < F.col("_earlier"))
    marked = marked.withColumn("reason", F.when(late, "out_of_order").otherwise(F.coalesce("reason", F.lit("valid"))))
    return copies.unionByName(marked.groupBy("reason").agg(F.count("*").alias("records")))


def add_category(df: DataFrame, column: str = "aqi", mode: str = "strict") -> DataFrame:
    """Add ``category``."""
    return df.withColumn("category", category(F.col(column), mode))


def category_attributes(df: DataFrame) -> DataFrame:
    """Add bounds, level, colour and advice of ``category``. The category table has five rows."""
    return df.join(F.broadcast(category_table(df.sparkSession)), "category", "left")
