"""Scoring of feature rows, and latency figures of the results."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.functions.columns import need_columns
from zephyra.plans.quantiles import VALUES_PER_AGGREGATE, quantiles
from zephyra.schemas import MAX_LATENCY_MS
from zephyra.sources.events import finite
from zephyra.sources.tables import read_or_empty
from zephyra.streaming.state import read_state


def validate_event(events: DataFrame) -> DataFrame:
    """Add ``error``: NULL, or what is wrong with ``city, timestamp, aqi``. Text that is no number counts as wrong, as do NaN and infinity."""
    need_columns(events, "city", "timestamp", "aqi")

    def number(name: str) -> Column:
        column = F.col(name)
        if isinstance(events.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
            return column
        return finite(column)

    error = F.lit(None).cast("string")
    for name in ("aqi", "timestamp"):
        error = F.when(F.col(name).isNotNull() & number(name).isNull(), f"{name} is not a number").otherwise(error)
    for name in ("aqi", "timestamp", "city"):
        error = F.when(F.col(name).isNull(), f"missing {name}").otherwise(error)
    return events.withColumn("error", error)


def assemble_features(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Feature columns as an array of single-precision numbers; a missing column or value is 0."""
    if not columns:
        raise ValueError("name the feature columns")
    present = set(df.columns)
    values = [
        F.coalesce(F.col(c).try_cast("float"), F.lit(0.0).cast("float")) if c in present else F.lit(0.0).cast("float")
        for c in columns
    ]
    return df.withColumn(output, F.array(*values))


def score(df: DataFrame, model, columns: list[str], now: Column | None = None) -> DataFrame:
    """Feature rows to result rows. Rows with an ``error`` get no prediction. Works on tables and streams.

    ``ingest_time``, when there, is what latency counts from; on a stream it ends at the start of the micro-batch, and
    ``latency_sink`` measures it to its end.
    """
    from zephyra.operators.models import assembled

    need_columns(df, "city", "timestamp", "aqi")
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    scored = model.transform(assembled(df, columns, fill=0.0))
    fine = error.isNull()
    emitted = F.current_timestamp() if now is None else now
    latency = F.lit(None).cast("double")
    if "ingest_time" in df.columns:
        latency = (F.unix_micros(emitted.cast("timestamp")) - F.unix_micros("ingest_time")) / 1000.0
    keep = [c for c in ("seq",) if c in df.columns]
    return scored.select(
        *keep,
        "city",
        "timestamp",
        F.col("aqi").alias("current_aqi"),
        F.when(fine, F.col("prediction")).alias("predicted_aqi"),
        latency.alias("latency_ms"),
        fine.alias("features_computed"),
        error.alias("error"),
    )


def latency_stats(
    results: DataFrame, order: list[str], limit_ms: float = MAX_LATENCY_MS, last: int | None = 1000
) -> DataFrame:
    """``events_processed, events_exceeding_max`` over all results, and ``min, max, mean, median, p95, p99`` of the last
    ``last`` ones by ``order``."""
    whole = results.agg(
        F.count("latency_ms").alias("events_processed"),
        F.count_if(F.col("latency_ms") > limit_ms).alias("events_exceeding_max"),
    )
    recent = results.where(F.col("latency_ms").isNotNull())
    if last is not None:  # a top-n: every task keeps its own n rows
        recent = recent.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    stats = recent.agg(
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        p.alias("_p"),
    )
    both = _one_row(whole, stats)
    return both.select(
        "events_processed",
        "min_latency_ms",
        "max_latency_ms",
        "mean_latency_ms",
        F.get("_p", F.lit(0)).alias("median_latency_ms"),
        F.get("_p", F.lit(1)).alias("p95_latency_ms"),
        F.get("_p", F.lit(2)).alias("p99_latency_ms"),
        "events_exceeding_max",
    )


def event_metrics(
    results: DataFrame, ts: str | None = None, keys: list[str] = (), limit: int = VALUES_PER_AGGREGATE
) -> DataFrame:
    """``event_count, error_count, error_rate, min/max/mean/p95/p99_latency_ms``, and with ``ts`` the events per second
    between the first and the last."""
    keys = list(keys)
    measures = [
        F.count("*").alias("event_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        (F.count_if(~F.col("success")) / F.count("*")).alias("error_rate"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    ]
    if ts:
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        measures.append(F.try_divide(F.count("*") * 1e6, F.max(us) - F.min(us)).alias("throughput_per_second"))
    whole = results.groupBy(*keys).agg(*measures)
    q = quantiles(results, ["latency_ms"], [0.95, 0.99], keys, limit)
    q = q.groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95_latency_ms"),
        F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99_latency_ms"),
    )
    return _one_row(whole, q, keys)


def _one_row(left: DataFrame, right: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Put two aggregates with one row per key side by side: a union and a maximum, no join."""
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names if c not in keys])


def event_metrics_stream(results: DataFrame, ts: str = "timestamp", width: str = "1 minute", watermark: str = "1 hour") -> DataFrame:
    """The same counts per tumbling window of a stream, one row when the watermark has passed the window; percentiles are
    sketches here. :func:`event_metrics_sink` gives exact ones, and with :func:`open_windows` those that are still open."""
    timed = results.withWatermark(ts, watermark).groupBy(F.window(ts, width))
    made = timed.agg(
        F.count("*").alias("event_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.percentile_approx("latency_ms", [0.95, 0.99], 10000).alias("_p"),
    )
    return made.select(
        F.col("window.start").alias("window_start"),
        "event_count",
        "error_count",
        (F.col("error_count") / F.col("event_count")).alias("error_rate"),
        "min_latency_ms",
        "max_latency_ms",
        "mean_latency_ms",
        F.get("_p", F.lit(0)).alias("p95_latency_ms"),
        F.get("_p", F.lit(1)).alias("p99_latency_ms"),
    )


def _of_histogram(counts: DataFrame) -> DataFrame:
    """Metrics of each window from ``window, latency_ms, n, errors``, a row per distinct latency."""
    n, latency = F.col("n"), F.col("latency_ms")
    known = F.sum(F.when(latency.isNotNull(), n))
    made = counts.groupBy("window").agg(
        F.sum(n).alias("event_count"),
        F.sum("errors").alias("error_count"),
        F.min(latency).alias("min_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
        F.try_divide(F.sum(latency * n), known).alias("mean_latency_ms"),
        F.percentile(latency, F.array(F.lit(0.95), F.lit(0.99)), n).alias("_p"),
    )
    return made.select(
        F.col("window.start").alias("window_start"),
        "event_count",
        "error_count",
        (F.col("error_count") / F.col("event_count")).alias("error_rate"),
        "min_latency_ms",
        "max_latency_ms",
        "mean_latency_ms",
        F.get("_p", F.lit(0)).alias("p95_latency_ms"),
        F.get("_p", F.lit(1)).alias("p99_latency_ms"),
    )


def event_metrics_sink(
    results: DataFrame, path: str, checkpoint: str, ts: str = "timestamp", width: str = "1 minute", watermark: str = "1 hour", **trigger
):
    """Write the metrics of every closed window of a stream, with exact percentiles, a folder per micro-batch.

    The state is a histogram of each open window, an entry per window and distinct latency, so a busy window is
    spread over the tasks. All entries of a window leave the state in the same micro-batch, which then has the whole histogram.
    A batch that is run again replaces what it wrote.
    """
    counts = results.withWatermark(ts, watermark).groupBy(F.window(ts, width), "latency_ms")
    counts = counts.agg(F.count("*").alias("n"), F.sum(F.when(~F.col("success"), 1).otherwise(0)).alias("errors"))

    def store(batch: DataFrame, batch_id: int) -> None:
        _of_histogram(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The metrics so far of the windows that :func:`event_metrics_sink` still holds, read from its state."""
    held = read_state(spark, checkpoint)
    counts = held.select("key.window", "key.latency_ms", F.col("value.count").alias("n"), F.col("value.sum").alias("errors"))
    return _of_histogram(counts)


def latency_sink(results: DataFrame, path: str, checkpoint: str, **trigger):
    """Write results a folder per micro-batch, and beside them when each batch was there in full (``<path>_finished``).

    A batch that is run again replaces both, so its results count as finished when they last were.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        spark = batch.sparkSession
        now = datetime.now(UTC)
        spark.createDataFrame([(now,)], "finished timestamp").coalesce(1).write.mode("overwrite").parquet(
            f"{path}_finished/batch={batch_id}"
        )

    return results.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finished_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`latency_sink` wrote, with ``batch`` and ``latency_ms``: from the ``ingest_time`` of a row to the moment its
    whole batch was written."""
    rows = read_or_empty(spark, path, schema, "batch")
    finished = read_or_empty(spark, f"{path}_finished", T.StructType([T.StructField("finished", T.TimestampType())]), "batch")
    both = rows.drop("latency_ms").join(finished, "batch")
    latency = (F.unix_micros("finished") - F.unix_micros(F.col("ingest_time").cast("timestamp"))) / 1000.0
    return both.withColumn("latency_ms", latency).drop("finished")


def stage_timing_stats(runs: DataFrame) -> DataFrame:
    """``operation, count, min_seconds, max_seconds, mean_seconds, total_seconds``."""
    return runs.where(F.col("operation").isNotNull()).groupBy("operation").agg(
        F.count("*").alias("count"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.avg("seconds").alias("mean_seconds"),
        F.sum("seconds").alias("total_seconds"),
    )
