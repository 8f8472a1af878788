"""Ready-made streaming jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.operators.alert_store import read_alerts, store_alerts
from zephyra.operators.alerts import model_alerts, rule_alerts
from zephyra.operators.features import event_features
from zephyra.plans.tables import write_out
from zephyra.schemas import ALERT_WINDOW_HOURS, PREDICTION_THRESHOLD, STREAMING_WINDOW_HOURS
from zephyra.sources.tables import read_or_empty
from zephyra.streaming.alerts import suppress_repeats_stream


def quarantine(decoded: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Write the events that carry an ``error`` away."""
    bad = decoded.where(F.col("error").isNotNull())
    return bad.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).start()


def alert_stream(results: DataFrame, threshold: float = PREDICTION_THRESHOLD, hours: int = ALERT_WINDOW_HOURS) -> DataFrame:
    """A stream of results (``city, timestamp, current_aqi, predicted_aqi, seq``) to sent alerts."""
    rules = rule_alerts(results, value="current_aqi").withColumn("seq", F.col("seq") * 2)
    models = model_alerts(results, threshold).withColumn("seq", F.col("seq") * 2 + 1)
    return suppress_repeats_stream(rules.unionByName(models, allowMissingColumns=True), hours)


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, handlers=(), **trigger):
    """Store alerts, a folder per micro-batch; every handler gets each batch as stored. A batch that is run again replaces
    what it stored before."""

    def store(batch: DataFrame, batch_id: int) -> None:
        store_alerts(batch, f"{path}/batch={batch_id}", mode="overwrite")
        for handle in handlers:
            handle(read_alerts(batch.sparkSession, f"{path}/batch={batch_id}"))

    return alerts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def feature_table_sink(
    events: DataFrame, history: str, output: str, checkpoint: str, hours: int = 2 * STREAMING_WINDOW_HOURS, **trigger
):
    """Features without per-city state, for cities too busy for one task, in a table with a folder per date. See
    :func:`feature_table_writer`."""
    put = feature_table_writer(history, output, hours)
    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def feature_table_writer(
    history: str, output: str, hours: int = 2 * STREAMING_WINDOW_HOURS
) -> Callable[[DataFrame, int], None]:
    """What :func:`feature_table_sink` does with a micro-batch.

    The batch is put into the history table (``date=/batch=``). The features of its dates, and of those up to ``hours``
    after its last reading, come from the batch operator over the history from ``hours`` before its first one, which spreads a city
    over its hours, and replace the folders of these dates. So readings that come late, by whatever time, are in the features
    of those after them, and a batch that is run again gives the same table. (After a late reading and a silence of over ``hours`` less
    a day the lags of the next readings stay as they were.) For lags whose value is older there is a second table,
    ``<output>_last``: for each date the last reading of each city up to its end. A trigger lists and reads the folders of its own
    dates alone. Readings without time stay in the history.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = write_out(batch).withColumns({"date": F.to_date("timestamp"), "batch": F.lit(str(batch_id))})
        _replace(rows, history, "date", "batch")
        reach, low, high = F.make_dt_interval(hours=F.lit(hours)), F.min("timestamp"), F.max("timestamp")
        begin, first, last = rows.agg(F.to_date(low - reach), F.to_date(low), F.to_date(high + reach)).first()
        if first is None:
            return
        recent = read_dates(spark, history, batch.schema, days(begin, last), "batch").drop("batch")
        older = _last_before(spark, f"{output}_last", batch.schema, begin)
        known = write_out(recent.unionByName(older))
        made = event_features(known.drop("date")).withColumn("date", F.to_date("timestamp"))
        _replace(made.where(F.col("date").between(F.lit(first), F.lit(last))), output, "date")
        _replace(_last_up_to(known, first, last), f"{output}_last", "date")

    return put


def days(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def read_dates(spark: SparkSession, path: str, schema: T.StructType, dates: list[date], *partitions: str) -> DataFrame:
    """The rows of some dates of a table with a folder per date. Only their folders are listed."""
    names = ",".join(f"date={d.isoformat()}" for d in dates)
    found = read_or_empty(spark, f"{path}/{{{names}}}", schema, "date", *partitions, base=path)
    return found.select(*schema.fieldNames(), "date", *partitions)


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write folders, and leave those that ``rows`` says nothing of."""
    spread = rows.hint("rebalance", *partitions)  # a large folder gets several files
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _last_before(spark: SparkSession, path: str, schema: T.StructType, day: date) -> DataFrame:
    """The last reading of each city before ``day``: as of the day before, or else as of the newest day that the table has."""
    found = read_dates(spark, path, schema, [day - timedelta(days=1)])
    if found.isEmpty():
        found = read_or_empty(spark, path, schema, "date").where(F.col("date") < F.lit(day))
        newest = found.agg(F.max("date")).first()[0]
        found = found.where(F.col("date") == F.lit(newest)).select(*schema.fieldNames(), "date")
    return found


def _last_up_to(rows: DataFrame, first: date, last: date) -> DataFrame:
    """For each date from ``first`` to ``last`` the last reading of each city up to its end."""
    order = Window.partitionBy("city", "_day").orderBy(F.desc("timestamp"), F.desc("seq"))
    known = rows.where("timestamp is not null and aqi is not null").withColumn("_day", F.greatest(F.to_date("timestamp"), F.lit(first)))
    ends = known.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "date")
    dated = ends.where(F.col("_day") <= F.lit(last)).withColumn("date", F.explode(F.sequence("_day", F.lit(last))))
    newest = Window.partitionBy("city", "date").orderBy(F.desc("_day"))
    return dated.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_day")
