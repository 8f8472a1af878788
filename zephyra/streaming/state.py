"""The state of a stream as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None, operator: int = 0) -> DataFrame:
    """The state of an operator of a stream, or of one of its variables, as the last finished micro-batch left it."""
    source = spark.read.format("statestore").option("operatorId", operator)
    return (source.option("stateVarName", variable) if variable else source).load(checkpoint)
