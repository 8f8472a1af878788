"""Bronze, silver and gold tables: partitioned Parquet, appended to, read with pruning."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.operators.clean import schema_gate


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType, *partitions: str, base: str | None = None
) -> DataFrame:
    """The table, or an empty one of that schema while nothing has been written. ``base`` is the folder of the table if
    ``path`` names some of its folders."""
    dates = [T.StructField(p, T.DateType() if p == "date" else T.StringType()) for p in partitions]
    full = T.StructType([f for f in schema.fields if f.name not in partitions] + dates)
    try:
        reader = spark.read.schema(full)
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def stamp_bronze(df: DataFrame, source: str) -> DataFrame:
    """Add ``source, ingestion_timestamp, retrieval_time, date``."""
    return df.withColumns(
        {
            "source": F.lit(source),
            "ingestion_timestamp": F.current_timestamp(),
            "retrieval_time": F.lit(0.0),
            "date": F.to_date("timestamp"),
        }
    )


def write_bronze(df: DataFrame, path: str, source: str) -> int:
    """Gate, stamp and append, one folder per source and date. Returns the number of rows written.

    The count is taken while writing. Dates are spread over the tasks by a rebalance, which splits a date that holds
    most of the rows.
    """
    from pyspark.sql import Observation

    seen = Observation()
    stamped = stamp_bronze(schema_gate(df), source)
    counted = stamped.hint("rebalance", "date").observe(seen, F.count("*").alias("records"))
    counted.write.mode("append").partitionBy("source", "date").parquet(path)
    return seen.get["records"]


def read_bronze(
    spark: SparkSession, path: str, source: str | None = None, date: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The landed rows; ``source`` and ``date`` prune folders."""
    from zephyra.schemas import BRONZE

    return _filtered(read_or_empty(spark, path, schema or BRONZE, "source", "date"), source=source, date=date)


def write_layer(df: DataFrame, path: str) -> None:
    """Append a silver or gold table, one folder per city and date.

    Rows are rebalanced by city and date: small folders get one file, and a folder with most of the rows several.
    """
    dated = df.withColumn("date", F.to_date("timestamp"))
    dated.hint("rebalance", "city", "date").write.mode("append").partitionBy("city", "date").parquet(path)


def read_layer(
    spark: SparkSession, path: str, schema: T.StructType, city: str | None = None, date: str | None = None
) -> DataFrame:
    """A silver or gold table; ``city`` and ``date`` prune folders."""
    return _filtered(read_or_empty(spark, path, schema, "city", "date"), city=city, date=date)


def _filtered(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value).cast(df.schema[name].dataType))
    return df


def write_report_json(report: DataFrame, path: str) -> None:
    """Write a tidy report as JSON lines."""
    report.write.mode("overwrite").json(path)
