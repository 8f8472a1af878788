"""Feature analysis. Every result is a tidy table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyra.functions.columns import long_rows, need_columns, numeric_columns, tidy
from zephyra.functions.moments import correlation, unbiased_kurtosis, unbiased_skewness
from zephyra.plans.quantiles import VALUES_PER_AGGREGATE, quantiles
from zephyra.plans.tables import write_out

QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def _check(df: DataFrame, target: str | None = None) -> None:
    if target is not None:
        need_columns(df, target)


def _per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """One pass over the table: ``feature, stat, value`` for every column and measure."""
    wide = df.agg(*[fn(F.col(c)).cast("double").alias(f"{c}::{name}") for c in columns for name, fn in measures.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(name).alias("stat"), F.col(f"`{c}::{name}`").alias("value"))
            for c in columns
            for name in measures
        ]
    )
    return wide.select(F.inline(rows))


def _quartiles(
    df: DataFrame, columns: list[str], names: dict[str, float], limit: int, known: DataFrame | None = None
) -> DataFrame:
    """``known`` are quartiles that were worked out before."""
    found = quantiles(df, columns, list(names.values()), limit=limit) if known is None else known
    label = None
    for name, p in names.items():
        label = (label.when if label is not None else F.when)(F.col("p") == p, name)
    return found.select("feature", label.alias("stat"), "value")


def feature_statistics(
    df: DataFrame, columns: list[str] | None = None, limit: int = VALUES_PER_AGGREGATE, quartiles: DataFrame | None = None
) -> DataFrame:
    """``feature, stat, value``: count, mean, std, min, quartiles, max, skewness, kurtosis, nulls and their share."""
    columns = columns or numeric_columns(df)
    measures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "skewness": unbiased_skewness,
        "kurtosis": unbiased_kurtosis,
        "null_count": lambda c: F.count_if(c.isNull()),
        "null_percentage": lambda c: F.try_divide(F.count_if(c.isNull()) * 100.0, F.count("*")),
    }
    return _per_column(df, columns, measures).unionByName(_quartiles(df, columns, QUARTILES, limit, quartiles))


def feature_distributions(
    df: DataFrame, columns: list[str] | None = None, limit: int = VALUES_PER_AGGREGATE, quartiles: DataFrame | None = None
) -> DataFrame:
    """``feature, stat, value``: mean, std, min, max, median, q25, q75, skewness, kurtosis."""
    columns = columns or numeric_columns(df)
    measures = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "skewness": unbiased_skewness,
        "kurtosis": unbiased_kurtosis,
    }
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return _per_column(df, columns, measures).unionByName(_quartiles(df, columns, names, limit, quartiles))


def _upper_triangle(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature_a, feature_b, r`` for every pair in column order. One aggregate over the table."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    wide = df.agg(
        *[correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, include_target: bool = True, target: str = "aqi"
) -> DataFrame:
    """``feature_a, feature_b, r`` for all ordered pairs; a constant column has r NULL everywhere."""
    columns = columns or numeric_columns(df)
    if not include_target:
        columns = [c for c in columns if c != target]
    upper = _upper_triangle(df, columns)
    lower = upper.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r")
    return upper.unionByName(lower).unionByName(_self_correlation(df, columns))


def _self_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """r = 1 with itself, unless the column is constant or has fewer than two values."""
    wide = df.agg(*[F.when(F.min(c) < F.max(c), 1.0).alias(c) for c in columns])
    rows = tidy(wide, columns, name="feature_a")
    return rows.select("feature_a", F.col("feature_a").alias("feature_b"), F.col("value").alias("r"))


def target_correlations(df: DataFrame, target: str = "aqi", columns: list[str] | None = None) -> DataFrame:
    """``feature, r`` with the target, strongest first; the target itself is listed too."""
    _check(df, target)
    columns = columns or numeric_columns(df)
    others = [c for c in columns if c != target]
    wide = df.agg(
        *[correlation(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in others],
        *([F.when(F.min(target) < F.max(target), 1.0).alias(target)] if target in columns else []),
    )
    rows = tidy(wide, columns, name="feature").withColumnRenamed("value", "r")
    return rows.orderBy(F.abs("r").desc_nulls_last(), "feature")


def feature_importance(df: DataFrame, target: str = "aqi", columns: list[str] | None = None) -> DataFrame:
    """``feature, importance``: |r| with the target, scaled to 0..1 over the features."""
    rows = target_correlations(df, target, columns).select("feature", F.abs("r").alias("strength"))
    whole = Window.partitionBy(F.lit(0))  # one row per column of the table
    low, high = F.min("strength").over(whole), F.max("strength").over(whole)
    return rows.select("feature", F.try_divide(F.col("strength") - low, high - low).alias("importance"))


def _outside(df: DataFrame, keys: list[str], columns: list[str], bounds: DataFrame, condition) -> DataFrame:
    """Values that fail against the bounds of their column. ``bounds`` has one row per column."""
    values = long_rows(df, columns, *keys)
    return values.join(F.broadcast(bounds), "feature").where(condition).select("feature", *keys, "value")


def outliers_iqr(
    df: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    threshold: float = 1.5,
    limit: int = VALUES_PER_AGGREGATE,
    quartiles: DataFrame | None = None,
) -> DataFrame:
    """``feature, keys..., value`` of the values outside ``[Q1 - k IQR, Q3 + k IQR]``. ``keys`` identify a row."""
    columns = columns or [c for c in numeric_columns(df) if c not in keys]
    q = quantiles(df, columns, [0.25, 0.75], limit=limit) if quartiles is None else quartiles
    q = q.groupBy("feature").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
    )
    reach = F.lit(float(threshold)) * (F.col("q3") - F.col("q1"))
    bounds = q.select("feature", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    return _outside(df, keys, columns, bounds, "value < low or value > high")


def outliers_zscore(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    """``feature, keys..., value`` of the values more than ``threshold`` sample deviations from the mean."""
    columns = columns or [c for c in numeric_columns(df) if c not in keys]
    rows = _per_column(df, columns, {"mean": F.avg, "std": F.stddev_samp})
    bounds = rows.groupBy("feature").agg(
        F.max(F.when(F.col("stat") == "mean", F.col("value"))).alias("mean"),
        F.max(F.when(F.col("stat") == "std", F.col("value"))).alias("std"),
    )
    far = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std"))) > float(threshold)
    return _outside(df, keys, columns, bounds, far)


def outliers(df: DataFrame, keys: list[str], method: str = "iqr", threshold: float = 1.5, **options) -> DataFrame:
    """:func:`outliers_iqr` or :func:`outliers_zscore` by name."""
    methods = {"iqr": outliers_iqr, "zscore": outliers_zscore}
    if method not in methods:
        raise ValueError(f"unknown method: {method}")
    return methods[method](df, keys, threshold=threshold, **options)


def group_consistency(df: DataFrame, key: str = "city", columns: list[str] | None = None) -> DataFrame:
    """``feature, <key>, scope, mean, std, count`` per key and over all keys, in one pass.

    ``count`` is the number of rows, nulls included.
    """
    need_columns(df, key)
    columns = columns or numeric_columns(df)
    sets = df.rollup(key).agg(
        F.grouping(key).alias("_all"),
        F.count("*").alias("count"),
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_std_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"_mean_{c}").alias("mean"), F.col(f"_std_{c}").alias("std"))
            for c in columns
        ]
    )
    scope = F.when(F.col("_all") == 1, "global").otherwise("group")
    return sets.select(key, scope.alias("scope"), "count", F.inline(rows)).select(
        "feature", key, "scope", "mean", "std", "count"
    )


def high_correlation_pairs(
    df: DataFrame, threshold: float = 0.7, target: str = "aqi", columns: list[str] | None = None
) -> DataFrame:
    """``feature_a, feature_b, r`` of the pairs without the target and with |r| above the threshold, strongest first."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    pairs = _upper_triangle(df, columns).where(F.abs("r") > threshold)
    return pairs.orderBy(F.abs("r").desc(), "feature_a", "feature_b")


def low_variance_features(df: DataFrame, threshold: float = 0.01, columns: list[str] | None = None) -> DataFrame:
    """``feature, variance`` of the columns with a sample variance below the threshold."""
    columns = columns or numeric_columns(df)
    wide = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return tidy(wide, columns, name="feature").withColumnRenamed("value", "variance").where(F.col("variance") < threshold)


def analysis_report(
    df: DataFrame, keys: list[str], target: str = "aqi", columns: list[str] | None = None
) -> DataFrame:
    """Everything above in one tidy table: ``section, feature, item, value``."""
    _check(df, target)
    columns = columns or [c for c in numeric_columns(df) if c not in keys]

    def part(rows: DataFrame, section: str, item, value: str = "value") -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"), "feature", item.cast("string").alias("item"), F.col(value).alias("value")
        )

    none = F.lit(None)
    matrix = correlation_matrix(df, columns).withColumnRenamed("feature_a", "feature")
    quartiles = write_out(quantiles(df, columns, list(QUARTILES.values())))  # three rows per column
    found = outliers_iqr(df, keys, columns, quartiles=quartiles)
    row_id = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    summary = df.agg(F.count("*").cast("double").alias("value")).select(F.lit(target).alias("feature"), "value")
    report = part(summary, "summary", F.lit("records"))
    for rows in (
        part(feature_statistics(df, columns, quartiles=quartiles), "statistics", F.col("stat")),
        part(feature_distributions(df, columns, quartiles=quartiles), "distributions", F.col("stat")),
        part(target_correlations(df, target, columns), "target_correlations", none, "r"),
        part(matrix, "correlation_matrix", F.col("feature_b"), "r"),
        part(feature_importance(df, target, columns), "importance", none, "importance"),
        part(found, "outliers", row_id),
    ):
        report = report.unionByName(rows)
    return report
