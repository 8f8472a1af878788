"""Standardisation with parameters learnt from a training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyra.functions.columns import need_columns, numeric_columns


def scaler_fit(train: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``position, feature, mean, var, scale`` per column. Population variance; a constant column gets scale 1."""
    columns = columns or numeric_columns(train)
    need_columns(train, *columns)
    wide = train.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.var_pop(c).alias(f"_var_{c}") for c in columns]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                F.col(f"_mean_{c}").alias("mean"),
                F.col(f"_var_{c}").alias("var"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows)).withColumn("scale", F.when(F.col("var") == 0, 1.0).otherwise(F.sqrt("var")))


def scaler_transform(df: DataFrame, params: DataFrame) -> DataFrame:
    """``(x - mean) / scale`` for the fitted columns; the others stay.

    ``params`` has one row per column of ``df``, so its values are put into the projection as literals.
    """
    fitted = {row["feature"]: row for row in params.collect()}
    need_columns(df, *fitted)

    def scaled(c: str):
        if c not in fitted:
            return F.col(c)
        row = fitted[c]
        return ((F.col(c) - F.lit(row["mean"])) / F.lit(row["scale"])).alias(c)

    return df.select(*map(scaled, df.columns))


def scaler_save(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)


def scaler_load(spark, path: str) -> DataFrame:
    return spark.read.schema("position int, feature string, mean double, var double, scale double").parquet(path)
