"""Landed files to reading rows."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.functions.columns import nan_to_null
from zephyra.schemas import FEED_PAYLOAD, POLLUTANTS, READING

CORRUPT = "_corrupt_record"


def read_history_csv(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """All CSV files of a folder, and of its folders, as text columns, each file by the names in its own header.

    The result has the columns of a reading and of ``extra``, NULL where a file lacks one, then ``_corrupt_record`` with
    malformed lines, then any further columns that a file has. The driver sees one row per file.
    """
    names = [f.name for f in READING.fields] + [f.name for f in (extra.fields if extra else [])]
    found = None
    for header, files in sorted(_headers(spark, path).items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*header, CORRUPT)])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(files)
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField(CORRUPT, T.StringType())]))
    have = set(found.columns)
    expected = [F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in (*names, CORRUPT)]
    return found.select(*expected, *[F.col(f"`{c}`") for c in found.columns if c not in (*names, CORRUPT)])


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their first line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("at", F.monotonically_increasing_id()).where("block = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.collect():
        cells = next(csv.reader([row["header"].removeprefix("\ufeff")]), [])
        found.setdefault(tuple(c.strip() for c in cells), []).append(unquote(row["file"]))
    return {header: sorted(files) for header, files in found.items() if header}


def coerce_types(df: DataFrame) -> DataFrame:
    """Text to timestamps and numbers; what does not parse becomes NULL, as does NaN."""
    made = {"timestamp": F.try_to_timestamp(F.col("timestamp").cast("string"))}
    for name in ["aqi", *POLLUTANTS]:
        if name in df.columns:
            made[name] = F.col(name).try_cast("double")
    typed = df.withColumns(made)
    numbers = [f.name for f in typed.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return typed.withColumns({name: nan_to_null(name) for name in numbers})


def coercion_counts(raw: DataFrame) -> DataFrame:
    """``invalid_timestamps, invalid_aqi``: null after :func:`coerce_types`; plus how many of them held text."""
    ts = F.try_to_timestamp(F.col("timestamp").cast("string"))
    aqi = F.col("aqi").try_cast("double")
    return raw.agg(
        F.count_if(ts.isNull()).alias("invalid_timestamps"),
        F.count_if(aqi.isNull()).alias("invalid_aqi"),
        F.count_if(ts.isNull() & F.col("timestamp").isNotNull()).alias("unparsable_timestamps"),
        F.count_if(aqi.isNull() & F.col("aqi").isNotNull()).alias("unparsable_aqi"),
    )


def flatten_feed_json(df: DataFrame, city: Column, payload: str = "payload", source: str = "feed") -> DataFrame:
    """Feed payloads (JSON text, or already parsed structs) to reading rows with a ``reason`` for rejected ones.

    A missing pollutant is NULL, a missing time is the time of ingest, and values out of range stay.
    """
    if isinstance(df.schema[payload].dataType, T.StringType):
        df = df.withColumn("_p", F.from_json(payload, FEED_PAYLOAD))
    else:
        df = df.withColumn("_p", F.col(payload))
    aqi = F.col("_p.data.aqi").try_cast("double")
    reason = (
        F.when(F.coalesce(F.col("_p.status") != "ok", F.lit(True)), "bad status")
        .when(F.col("_p.data").isNull(), "no data")
        .when(F.col("_p.data.aqi").isNull(), "missing aqi")
        .when(aqi.isNull(), "invalid aqi")
    )
    iso = F.nullif(F.col("_p.data.time.iso"), F.lit(""))
    return df.select(
        *[c for c in df.columns if c not in ("_p", payload, "city")],
        city.alias("city"),
        F.when(iso.isNull(), F.current_timestamp()).otherwise(F.try_to_timestamp(iso)).alias("timestamp"),
        aqi.alias("aqi"),
        *[F.col(f"_p.data.iaqi.{name}.v").alias(name) for name in POLLUTANTS],
        F.lit(source).alias("source"),
        reason.alias("reason"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull())
