"""Evaluation of predictions. Aggregates only; ``keys`` evaluates several models or groups in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyra.plans.ordered import join_on
from zephyra.plans.quantiles import VALUES_PER_AGGREGATE, quantiles


def _residual(actual: str, predicted: str):
    return F.col(actual) - F.col(predicted)


def regression_metrics(
    df: DataFrame, actual: str = "y_true", predicted: str = "y_pred", keys: list[str] = ()
) -> DataFrame:
    """``[keys,] n, rmse, mae, r2, mape`` over the rows where both are known; mape skips actual values of 0."""
    e = _residual(actual, predicted)
    known = df.where(e.isNotNull())
    y = F.col(actual)
    share = F.when(y != 0, F.abs(e) / F.abs(y) * 100)
    made = known.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(share).alias("mape"),
    )
    return made


def checked_metrics(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """:func:`regression_metrics` that raises for an empty table or a missing side."""
    for name in (actual, predicted):
        if name not in df.columns:
            raise ValueError(f"missing column: {name}")
    sides = df.agg(
        F.count("*").alias("rows"), F.count_if(_residual(actual, predicted).isNull()).alias("unpaired")
    ).first()
    if sides["rows"] == 0:
        raise ValueError("nothing to evaluate")
    if sides["unpaired"]:
        raise ValueError(f"{sides['unpaired']} rows lack an actual or a predicted value")
    return regression_metrics(df, actual, predicted)


def residual_analysis(
    df: DataFrame, actual: str = "y_true", predicted: str = "y_pred", keys: list[str] = ()
) -> DataFrame:
    """``residual_mean, _std, _min, _max, _skewness, _kurtosis``: population moments, excess kurtosis."""
    e = _residual(actual, predicted)
    made = df.select(*keys, e.alias("e")).groupBy(*keys).agg(
        F.avg("e").alias("residual_mean"),
        F.stddev_pop("e").alias("residual_std"),
        F.min("e").alias("residual_min"),
        F.max("e").alias("residual_max"),
        F.when(F.min("e") < F.max("e"), F.skewness("e")).alias("residual_skewness"),
        F.when(F.min("e") < F.max("e"), F.kurtosis("e")).alias("residual_kurtosis"),
    )
    return made


def prediction_errors(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Add ``residual, error`` (absolute) and ``error_pct``; the last is NULL for an actual value of 0."""
    e = _residual(actual, predicted)
    y = F.col(actual)
    return df.select(
        "*", e.alias("residual"), F.abs(e).alias("error"), F.when(y != 0, F.abs(e) / F.abs(y) * 100).alias("error_pct")
    )


def error_statistics(
    df: DataFrame,
    actual: str = "y_true",
    predicted: str = "y_pred",
    keys: list[str] = (),
    limit: int = VALUES_PER_AGGREGATE,
) -> DataFrame:
    """``[keys,] measure, mean, std, min, max, median, q25, q75`` of ``error`` and ``error_pct``."""
    keys = list(keys)
    errors = prediction_errors(df, actual, predicted).select(*keys, "error", "error_pct")
    columns = ["error", "error_pct"]
    wide = errors.groupBy(*keys).agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = wide.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("s")) for c in columns]))
    ).select(*keys, "measure", "s.*")
    q = quantiles(errors, columns, [0.25, 0.5, 0.75], keys, limit).groupBy(*keys, F.col("feature").alias("measure")).agg(
        *[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for name, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))
        ]
    )
    return join_on(rows, q, [*keys, "measure"], "left")


def residual_outliers(
    df: DataFrame, threshold_std: float = 2.0, actual: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """Rows whose absolute residual exceeds ``threshold_std`` population deviations of all residuals."""
    e = _residual(actual, predicted)
    sigma = df.agg(F.stddev_pop(e).alias("s")).first()["s"]
    if sigma is None:
        raise ValueError("nothing to evaluate")
    return df.withColumn("residual", e).where(F.abs("residual") > F.lit(threshold_std * sigma))


def evaluation_report(
    df: DataFrame, threshold_std: float = 2.0, actual: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """``section, name, value``: metrics, residuals, error statistics, number of rows and of outliers."""

    def rows(part: DataFrame, section: str, columns: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
        return part.select(F.lit(section).alias("section"), F.inline(pairs))

    metrics = regression_metrics(df, actual, predicted)
    residuals = residual_analysis(df, actual, predicted)
    errors = error_statistics(df, actual, predicted)
    report = rows(metrics, "metrics", ["rmse", "mae", "r2", "mape"])
    report = report.unionByName(rows(residuals, "residuals", residuals.columns))
    for measure in ("error", "error_pct"):
        part = errors.where(F.col("measure") == measure)
        report = report.unionByName(rows(part, measure, ["mean", "std", "min", "max", "median", "q25", "q75"]))
    report = report.unionByName(rows(metrics.select(F.col("n").alias("n_samples")), "size", ["n_samples"]))
    found = residual_outliers(df, threshold_std, actual, predicted).agg(F.count("*").alias("n_outliers"))
    return report.unionByName(rows(found, "size", ["n_outliers"]))


def compare_models(metrics: DataFrame) -> DataFrame:
    """One row per model, best r2 first."""
    return metrics.orderBy(F.col("r2").desc_nulls_last(), "model")


def best_model(metrics: DataFrame, metric: str = "r2") -> DataFrame:
    """The best row: highest r2, or lowest rmse or mae. Models without that metric are skipped."""
    if metric not in ("r2", "rmse", "mae"):
        raise ValueError(f"unknown metric: {metric}")
    known = metrics.where(F.col(metric).isNotNull())
    order = F.col(metric).desc() if metric == "r2" else F.col(metric).asc()
    return known.orderBy(order, "model").limit(1)
