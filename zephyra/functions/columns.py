"""Small helpers for choosing and reshaping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def need_columns(df: DataFrame, *names: str) -> None:
    """Fail early, with the missing names, rather than inside a plan."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def natural_key(df: DataFrame) -> list[str]:
    """Key of a reading; a pollutant column widens it."""
    return [name for name in ("city", "timestamp", "pollutant_type") if name in df.columns]


def nan_to_null(column: str) -> Column:
    """NaN would spread through every average, so it becomes NULL on the way in."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias(column)


def long_rows(df: DataFrame, columns: list[str], *keep: str, name: str = "feature") -> DataFrame:
    """One row per input row and column: ``keep..., <name>, value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def tidy(df: DataFrame, columns: list[str], *keep: str, name: str = "stat") -> DataFrame:
    """The same reshape for a small table of results."""
    return long_rows(df, columns, *keep, name=name)
