"""Column profiles of any span of dates from small summaries of each date.

A summary has one row per date and column: counts, moments and range, which merge exactly, a sketch of the distinct values (HLL)
and one of the order of the values (KLL), which merge with a known error. A profile of a month or a year reads these rows
alone, and a date whose readings change is summarised anew by itself. ``quality.column_profile`` and
``profile.feature_statistics`` give the exact figures of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.functions.columns import numeric_columns
from zephyra.sources.tables import read_or_empty

#: 2**DISTINCT_BITS registers: a standard error of about 0.8 percent.
DISTINCT_BITS = 14
#: Size of the sketch of order: ranks within about 0.7 percent.
ORDER_SIZE = 400
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}

SUMMARY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("feature", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("distinct", T.BinaryType()),
        T.StructField("order", T.BinaryType()),
    ]
)


def daily_summaries(df: DataFrame, columns: list[str] | None = None, ts: str = "timestamp") -> DataFrame:
    """A row per date and numeric column. NaN counts as missing; rows without time have no date and are left out.

    One shuffle, after each task has summarised its rows.
    """
    columns = columns or numeric_columns(df)

    def number(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        return F.nanvl(value, F.lit(None).cast("double")) + F.lit(0.0)  # -0.0 is 0.0

    dated = df.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("date"), *[number(c).alias(f"_{i}") for i, c in enumerate(columns)])
    made = dated.groupBy("date").agg(F.count("*").alias("records"), *[_summary(f"_{i}").alias(f"_{i}") for i in range(len(columns))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("s")) for i, c in enumerate(columns)])
    long = made.select("date", "records", F.inline(rows))
    return long.select("date", "feature", "records", "s.*").select(*SUMMARY.fieldNames())


def _summary(c: str) -> Column:
    value = F.col(c)
    return F.struct(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), DISTINCT_BITS).alias("distinct"),
        F.kll_sketch_agg_double(value, ORDER_SIZE).alias("order"),
    )


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Put the dates of ``summaries`` into the table; other dates stay as they are."""
    few = summaries.hint("rebalance", "date")
    few.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, SUMMARY, "date").select(*SUMMARY.fieldNames())


def profile_of(summaries: DataFrame, first: object = None, last: object = None) -> DataFrame:
    """``feature, records, missing, missing_pct, min, max, mean, std, distinct, q25, median, q75`` over the dates from
    ``first`` to ``last`` (all, where not given). ``distinct`` and the quartiles are estimates, the rest is exact. ``std`` is that of a
    sample. A column without values has NULL figures and 0 distinct ones."""
    if first is not None:
        summaries = summaries.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        summaries = summaries.where(F.col("date") <= F.lit(last).cast("date"))
    some = F.col("n") > 0
    merged = summaries.groupBy("feature").agg(
        F.sum("records").alias("records"),
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        F.collect_list(F.when(some, F.struct("n", "mean", "m2"))).alias("_parts"),  # one for each date
        F.hll_union_agg("distinct").alias("_distinct"),
        F.kll_merge_agg_double(F.when(some, F.col("order"))).alias("_order"),
    )

    def spread(total: Column, part: Column) -> Column:
        return total + part["m2"] + part["n"] * (part["mean"] - F.col("mean")) * (part["mean"] - F.col("mean"))

    squares = F.aggregate("_parts", F.lit(0.0), spread)
    known = F.col("n") > 0
    return merged.select(
        "feature",
        "records",
        (F.col("records") - F.col("n")).alias("missing"),
        ((F.col("records") - F.col("n")) * 100.0 / F.col("records")).alias("missing_pct"),
        "min",
        "max",
        "mean",
        F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1))).alias("std"),
        F.hll_sketch_estimate("_distinct").alias("distinct"),
        *[F.when(known, F.kll_sketch_get_quantile_double("_order", F.lit(p))).alias(name) for name, p in QUARTILES.items()],
    )
