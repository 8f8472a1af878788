"""One query per operator over the given tables. ``oracle.py`` holds the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.operators import alert_store, alerts, clean, evaluate, features, models, profile, quality, registry
from zephyra.operators import rollups, scaling, serving, splits
from zephyra.plans.tables import write_out
from zephyra.schemas import FEATURES, LAG_FEATURES, POLLUTANTS, ROLLING_FEATURES
from zephyra.session import configure, shared_dir
from zephyra.sources import events as messages
from zephyra.sources import landing, tables
from zephyra.streaming import scoring
from zephyra.streaming.alerts import state_entries, suppress_repeats_stream
from zephyra.streaming.clean import deduplicate_stream
from zephyra.streaming.features import state_stats, stream_features
from zephyra.workload.views import readings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOURLY = ["city", "_hour"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


# ------------------------------------------------------------------ helpers


def us(column: str = "timestamp", name: str | None = None) -> Column:
    """A timestamp as microseconds, which every engine prints alike."""
    return F.unix_micros(F.col(column).cast("timestamp")).alias(name or f"{column}_us")


def r6(column: Column | str, name: str | None = None) -> Column:
    """Six decimals. The small shift keeps exact ties such as 1/32 from falling to either side."""
    column = F.col(column) if isinstance(column, str) else column
    made = F.round(column + 1e-9, 6)
    return made.alias(name) if name else made


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[r6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def hourly(df: DataFrame) -> DataFrame:
    """Readings with the hour as part of the key, so that there are copies to remove."""
    return df.withColumn("_hour", F.date_trunc("hour", "timestamp"))


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *MEASURES)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    value = F.col("value")
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("model"), value.alias("y_true"),
        (value * 0.9 + 5).alias("y_pred"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with a prediction, as the scoring step gives them."""
    found = readings(spark, folder).where("aqi is not null")
    return found.select(
        "seq", "city", "timestamp", F.col("aqi").alias("current_aqi"), (F.col("aqi") * 0.9 + 5).alias("predicted_aqi")
    )


def sent_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alert_store.stored_form(alerts.alert_flow(results(spark, folder)).drop("seq")).drop("created_at")


def all_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and model alerts before suppression."""
    rows = results(spark, folder)
    rules = alerts.rule_alerts(rows, value="current_aqi")
    return rules.unionByName(alerts.model_alerts(rows), allowMissingColumns=True)


def acks_of(rows: DataFrame) -> DataFrame:
    """Every alert whose reading has a number divisible by 3 is acknowledged."""
    return rows.where(F.col("seq") % 3 == 0).select(
        "alert_id", F.col("timestamp").alias("acknowledged_at"), F.lit("operator").alias("acknowledged_by")
    )


def now_of(rows: DataFrame) -> Column:
    """The newest stamp, looked up once."""
    last = rows.agg(F.max(F.unix_micros("timestamp"))).first()[0]
    return F.timestamp_micros(F.lit(last))


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), "o_totalprice"
    )


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def fewer_partitions(spark: SparkSession):
    """A stream keeps the number of partitions it starts with; one for each core here."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def run_stream(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all there is, into a Parquet folder, and read that. Its checkpoint stays in ``folder/checkpoint``."""
    with fewer_partitions(spark):
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
        running = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    return run_stream(spark, stream, new_folder(spark, name))


def reading_stream(
    spark: SparkSession, folder: str, batches: int = 4, rows_per_file: int = 1_000_000, rows_per_batch: int = 1_000_000
) -> DataFrame:
    """The readings as a stream of that many micro-batches in time order, or more, so that one holds about ``rows_per_batch``: a
    city's part of a micro-batch is in the memory of one worker. Parts are written one after another, as many files each as
    the rows ask for, and read a part at a time. Readings without time are in the first part."""
    rows = readings(spark, folder).where("aqi is not null")
    path = new_folder(spark, "readings")
    at = F.unix_micros("timestamp")
    total = rows.count()
    batches = max(batches, -(-total // rows_per_batch))
    cuts = rows.select(at.cast("double").alias("at")).approxQuantile("at", [i / batches for i in range(1, batches)], min(0.01, 0.1 / batches))
    files = max(1, -(-total // (batches * rows_per_file)))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(at >= low)
        if high is not None:
            part = part.where((at < high) | at.isNull()) if low is None else part.where(at < high)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


# ------------------------------------------------------- sources and sinks


@query
def read_history_csv(spark, folder):
    """Readings written as CSV, read back and coerced. Every 41st value is text."""
    path = new_folder(spark, "csv")
    rows = readings(spark, folder)
    text = rows.select(
        "city",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("seq") % 41 == 0, "n/a").otherwise(F.col("aqi").cast("string")).alias("aqi"),
        F.col("pm25").cast("string").alias("pm25"),
        *[F.lit(None).cast("string").alias(p) for p in POLLUTANTS if p != "pm25"],
        "seq",
    )
    # two kinds of files: all columns, and some of them in another order with one that nobody knows
    text.where("seq % 2 = 0").write.option("header", True).csv(f"{path}/whole")
    few = text.where("seq % 2 = 1").select("seq", "pm25", "aqi", F.lit("x").alias("remark"), "timestamp", "city")
    few.write.option("header", True).csv(f"{path}/few")
    extra = T.StructType([T.StructField("seq", T.StringType())])
    made = landing.coerce_types(landing.read_history_csv(spark, path, extra).drop(landing.CORRUPT))
    return made.select(F.col("seq").cast("long").alias("seq"), "city", us(), "aqi", "pm25")


@query
def coercion_counts(spark, folder):
    rows = readings(spark, folder).select(
        F.when(F.col("seq") % 43 == 0, "not a date").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(F.col("seq") % 41 == 0, "n/a").otherwise(F.col("aqi").cast("string")).alias("aqi"),
    )
    return landing.coercion_counts(rows)


def _payloads(spark, folder):
    seq = F.col("seq")
    body = F.to_json(
        F.struct(
            F.when(seq % 41 == 0, "error").otherwise("ok").alias("status"),
            F.when(
                seq % 43 != 0,
                F.struct(
                    F.when(seq % 47 == 0, "-").otherwise(F.col("aqi").cast("string")).alias("aqi"),
                    F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("iso")).alias("time"),
                    F.struct(F.when(seq % 7 != 0, F.struct(F.col("pm25").alias("v"))).alias("pm25")).alias("iaqi"),
                ),
            ).alias("data"),
        )
    )
    return readings(spark, folder).select("seq", "city", body.alias("payload"))


@query
def flatten_feed_json(spark, folder):
    made = landing.flatten_feed_json(_payloads(spark, folder), F.col("city"))
    good = F.col("reason").isNull()
    return made.select(
        "seq", "city", F.when(good, us().cast("string")).alias("timestamp_us"), F.when(good, F.col("aqi")).alias("aqi"),
        F.when(good, F.col("pm25")).alias("pm25"), "no2", "reason",
    )


def _event_text(spark, folder):
    seq = F.col("seq")
    body = F.to_json(
        F.struct(
            "city",
            (F.unix_micros("timestamp") / 1e6).alias("timestamp"),
            "aqi",
            F.create_map(F.lit("pm25"), F.col("pm25")).alias("pollutants"),
        )
    )
    wrong = F.when(seq % 41 == 0, "{broken")
    for remainder, stamp in ((1, "1e300"), (2, '"NaN"'), (3, '"Infinity"')):
        wrong = wrong.when(seq % 41 == remainder, F.format_string(f'{{"city": "%s", "timestamp": {stamp}, "aqi": 7}}', "city"))
    wrong = wrong.when(seq % 41 == 4, F.format_string('{"city": "%s", "timestamp": 5, "aqi": "NaN"}', "city"))
    return readings(spark, folder).select("seq", wrong.otherwise(body).alias("value"))


@query
def decode_events(spark, folder):
    made = messages.spread_pollutants(messages.decode_events(_event_text(spark, folder)))
    return made.select("seq", "city", us().cast("string").alias("timestamp_us"), "aqi", "pm25", "error")


@query
def encode_and_route_events(spark, folder):
    rows = readings(spark, folder).select("city", F.unix_micros("timestamp").alias("timestamp"), "aqi", "seq")
    routed = messages.encode_and_route_events(rows, "readings")
    body = F.from_json("value", "city string, timestamp long, aqi double, seq long")
    return routed.select("topic", "key", body.alias("b")).select("topic", "key", "b.seq", "b.timestamp", "b.aqi")


@query
def route_counts(spark, folder):
    return messages.route_counts(readings(spark, folder))


@query
def bronze_round_trip(spark, folder):
    """Land, then read one source back through partition pruning."""
    path = new_folder(spark, "bronze")
    rows = readings(spark, folder).drop("source").withColumns(
        {p: F.lit(None).cast("double") for p in POLLUTANTS if p != "pm25"}
    )
    written = tables.write_bronze(rows, path, "events")
    back = tables.read_bronze(spark, path, source="events")
    return back.groupBy("source", F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("records"),
        F.count("aqi").alias("known"),
        r6(F.sum("pm25"), "pm25"),
        F.max("retrieval_time").alias("retrieval_time"),
        F.lit(written).cast("long").alias("written"),
    )


@query
def layer_round_trip(spark, folder):
    """Write the silver layer by city and date, and read one city."""
    path = new_folder(spark, "silver")
    silver = clean.clean(readings(spark, folder))
    tables.write_layer(silver, path)
    back = tables.read_layer(spark, path, silver.schema, city="error")
    return back.select("seq", "city", us(), "aqi", F.col("date").cast("string").alias("date"))


# ------------------------------------------------------------------ cleaning


@query
def gate_counts(spark, folder):
    return clean.gate_counts(clean.schema_gate(readings(spark, folder)))


@query
def dedup(spark, folder):
    return clean.deduplicate(hourly(readings(spark, folder)), HOURLY).select("seq", "city", us(), "aqi", "pm25")


@query
def drop_missing(spark, folder):
    return clean.drop_missing_critical(readings(spark, folder)).select("seq", "city", us(), "aqi")


@query
def filter_range(spark, folder):
    return clean.filter_range(readings(spark, folder)).select("seq", "city", us(), "aqi")


@query
def out_of_order(spark, folder):
    return clean.mark_out_of_order(readings(spark, folder)).select("seq", "city", us(), "late")


@query
def out_of_order_previous(spark, folder):
    marked = clean.mark_out_of_order(readings(spark, folder), mode="previous")
    return marked.select("seq", "city", us(), "late")


@query
def quality_flags(spark, folder):
    flagged = clean.quality_flags(hourly(readings(spark, folder)), HOURLY)
    return flagged.select("seq", "city", us(), F.array_join("quality_flags", ",").alias("flags"))


@query
def clean_silver(spark, folder):
    made = clean.clean(hourly(readings(spark, folder)), HOURLY)
    return made.select("seq", "city", us(), "aqi", "pm25", F.size("quality_flags").alias("flags"))


@query
def rejection_counts(spark, folder):
    return clean.rejection_counts(hourly(readings(spark, folder)), HOURLY)


@query
def aqi_category(spark, folder):
    rows = clean.add_category(readings(spark, folder))
    rows = rows.withColumn("strict", F.col("category"))
    return clean.add_category(rows, mode="continuous").select("seq", "aqi", "strict", F.col("category").alias("continuous"))


@query
def category_attributes(spark, folder):
    made = clean.category_attributes(clean.add_category(readings(spark, folder)))
    bounds = [F.col(c).cast("double").alias(c) for c in ("threshold_min", "threshold_max")]
    return made.select("seq", "category", *bounds, "alert_level", "color", "recommendation")


# -------------------------------------------------------------- data quality


@query
def missing_by_column(spark, folder):
    return quality.missing_by_column(readings(spark, folder))


@query
def out_of_range_count(spark, folder):
    return quality.out_of_range_count(readings(spark, folder))


@query
def duplicate_count(spark, folder):
    return quality.duplicate_count(hourly(readings(spark, folder)), HOURLY)


@query
def quality_score(spark, folder):
    return quality.quality_score(hourly(readings(spark, folder)).drop("timestamp").withColumnRenamed("_hour", "timestamp"))


@query
def quality_score_rows(spark, folder):
    rows = hourly(readings(spark, folder)).drop("timestamp").withColumnRenamed("_hour", "timestamp")
    return quality.quality_score(rows, mode="rows")


@query
def quality_alerts(spark, folder):
    rows = hourly(readings(spark, folder)).drop("timestamp").withColumnRenamed("_hour", "timestamp")
    return quality.quality_alerts(quality.quality_summary(rows))


@query
def quality_recommendations(spark, folder):
    rows = hourly(readings(spark, folder)).drop("timestamp").withColumnRenamed("_hour", "timestamp")
    return quality.quality_recommendations(quality.quality_summary(rows))


@query
def column_profile(spark, folder):
    made = quality.column_profile(readings(spark, folder))
    return made.select("column", "missing", r6("missing_pct", "missing_pct"), "distinct", "type")


@query
def group_profile(spark, folder):
    return quality.group_profile(readings(spark, folder))


@query
def quality_report(spark, folder):
    made = quality.quality_report(readings(spark, folder))
    return made.select("section", "item", "measure", r6("value", "value"), "text")


@query
def pipeline_metrics(spark, folder):
    """Bronze to gold with counts; the counts are a record of the run."""
    metrics = quality.RunMetrics("run")
    rows = readings(spark, folder)
    with metrics.stage("silver_transform"):
        counts = {row["reason"]: row["records"] for row in clean.rejection_counts(rows).collect()}
    with metrics.stage("gold_transform"):
        gold = features.build_gold(clean.clean(rows), bound=rows).agg(F.count("*").alias("n"), F.count("season").alias("s")).first()
    with metrics.stage("quality"):
        score = quality.quality_score(rows).first()
    metrics.values.update(
        bronze_ingested=score["total_records"],
        valid_records=counts["valid"],
        rejected_records=score["total_records"] - counts["valid"],
        gold_stored=gold["n"],
        quality_score=score["quality_score"],
    )
    made = metrics.table(spark)
    return made.where("measure is not null").select("run_id", "measure", r6("value", "value"))


# --------------------------------------------------------------- features


def _feature_rows(df: DataFrame, names: list[str]) -> DataFrame:
    return rounded(df.select("seq", "city", us(), *names))


@query
def lag_rows(spark, folder):
    return _feature_rows(features.lag_rows(readings(spark, folder)), LAG_FEATURES)


@query
def lag_rows_by_station(spark, folder):
    return _feature_rows(features.lag_rows(readings(spark, folder), keys=["station_id"]), LAG_FEATURES)


@query
def rolling_rows(spark, folder):
    return _feature_rows(features.rolling_rows(readings(spark, folder)), ROLLING_FEATURES)


@query
def rolling_range(spark, folder):
    return _feature_rows(features.rolling_range(readings(spark, folder)), ROLLING_FEATURES)


@query
def asof_lags(spark, folder):
    return _feature_rows(features.asof_lags(readings(spark, folder)), LAG_FEATURES)


@query
def trailing_stats(spark, folder):
    return _feature_rows(features.trailing_stats(readings(spark, folder)), ROLLING_FEATURES)


@query
def event_features(spark, folder):
    return _feature_rows(features.event_features(readings(spark, folder)), FEATURES)


@query
def window_state_stats(spark, folder):
    made = features.window_state_stats(readings(spark, folder))
    return made.select(
        "city", us(), "buffer_size", us("oldest_timestamp"), us("newest_timestamp"),
        r6("time_span_hours", "time_span_hours"),
    )


@query
def temporal_parts(spark, folder):
    rows = readings(spark, folder).select("seq", "timestamp")
    sunday = features.temporal_parts(rows, week="sunday")
    sunday = sunday.withColumnsRenamed({"day_of_week": "sunday_day", "is_weekend": "sunday_weekend"})
    return features.temporal_parts(sunday.select("seq", "timestamp", "sunday_day", "sunday_weekend")).select(
        "seq", "hour_of_day", "day_of_week", "month", "is_weekend", "sunday_day", "sunday_weekend"
    )


@query
def season(spark, folder):
    """Over the order dates, which cover all months."""
    return features.add_season(order_rows(spark, folder)).select("seq", "season")


@query
def fill_missing(spark, folder):
    return features.fill_missing(readings(spark, folder)).select("seq", "city", us(), "aqi", "pm25")


@query
def build_gold(spark, folder):
    rows = readings(spark, folder)
    silver = clean.clean(hourly(rows), HOURLY)
    return _feature_rows(features.build_gold(silver, bound=rows), ["aqi", "pm25", *FEATURES])


@query
def build_gold_range(spark, folder):
    rows = readings(spark, folder)
    silver = clean.clean(hourly(rows), HOURLY)
    return _feature_rows(features.build_gold(silver, mode="range", bound=rows), ["aqi", "pm25", *FEATURES])


@query
def scaler_fit(spark, folder):
    return rounded(scaling.scaler_fit(lineitem(spark, folder), MEASURES).drop("position"))


@query
def scaler_transform(spark, folder):
    rows = lineitem(spark, folder)
    made = scaling.scaler_transform(rows, scaling.scaler_fit(rows, MEASURES))
    return rounded(made.select("l_orderkey", "l_linenumber", *MEASURES))


# ---------------------------------------------------------------- profiling


@query
def feature_statistics(spark, folder):
    return rounded(profile.feature_statistics(lineitem(spark, folder), MEASURES))


@query
def feature_statistics_sparse(spark, folder):
    """A column without any value, by the way for tables of any size."""
    rows = table(spark, folder, "lineitem").select(*MEASURES, F.lit(None).cast("double").alias("nothing"))
    return rounded(profile.feature_statistics(rows, [*MEASURES, "nothing"], limit=0))


@query
def feature_distributions(spark, folder):
    return rounded(profile.feature_distributions(readings(spark, folder), ["aqi", "pm25"]))


@query
def correlation_matrix(spark, folder):
    rows = lineitem(spark, folder).withColumn("constant", F.lit(1.0))
    return rounded(profile.correlation_matrix(rows, [*MEASURES, "constant"]))


@query
def target_correlations(spark, folder):
    return rounded(profile.target_correlations(lineitem(spark, folder), "l_extendedprice", MEASURES))


@query
def feature_importance_corr(spark, folder):
    return rounded(profile.feature_importance(lineitem(spark, folder), "l_extendedprice", MEASURES))


@query
def outliers_iqr(spark, folder):
    return profile.outliers_iqr(readings(spark, folder), ["seq"], ["aqi", "pm25"])


@query
def outliers_zscore(spark, folder):
    return profile.outliers_zscore(readings(spark, folder), ["seq"], ["aqi", "pm25"], 3.0)


@query
def group_consistency(spark, folder):
    return rounded(profile.group_consistency(lineitem(spark, folder), "l_returnflag", MEASURES))


@query
def high_correlation_pairs(spark, folder):
    """With derived columns, so that some pairs are strong."""
    rows = lineitem(spark, folder).withColumns(
        {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "double_tax": F.col("l_tax") * 2}
    )
    return rounded(profile.high_correlation_pairs(rows, 0.7, "l_quantity", [*MEASURES, "net", "double_tax"]))


@query
def low_variance(spark, folder):
    rows = lineitem(spark, folder).withColumn("constant", F.lit(1.0))
    return rounded(profile.low_variance_features(rows, 0.01, [*MEASURES, "constant"]))


@query
def analysis_report(spark, folder):
    """The report is written as JSON and read back."""
    path = new_folder(spark, "report")
    made = profile.analysis_report(readings(spark, folder).drop("station_id"), ["seq"], columns=["aqi", "pm25"])
    tables.write_report_json(made, path)
    back = spark.read.schema("section string, feature string, item string, value double").json(path)
    return rounded(back)


# ------------------------------------------------------------------- splits


@query
def expanding_folds(spark, folder):
    return splits.expanding_folds(order_rows(spark, folder)).select("fold", "role", "seq")


@query
def expanding_folds_time(spark, folder):
    return splits.expanding_folds(order_rows(spark, folder), mode="time").select("fold", "role", "seq")


@query
def holdout_split(spark, folder):
    return splits.holdout_split(order_rows(spark, folder), 0.2).select("seq", "role")


@query
def holdout_split_null_time(spark, folder):
    """Every tenth order has no timestamp; those come first."""
    rows = order_rows(spark, folder)
    rows = rows.withColumn("timestamp", F.when(F.col("seq") % 10 != 0, F.col("timestamp")))
    return splits.holdout_split(rows, 0.2).select("seq", "role")


@query
def leakage_check(spark, folder):
    made = splits.leakage_check(splits.expanding_folds(order_rows(spark, folder)))
    return made.select("fold", us("max_train"), us("min_test"), "no_leakage")


@query
def leakage_check_time(spark, folder):
    made = splits.leakage_check(splits.expanding_folds(order_rows(spark, folder), mode="time"))
    return made.select("fold", us("max_train"), us("min_test"), "no_leakage")


# --------------------------------------------------------------- evaluation


@query
def regression_metrics(spark, folder):
    return rounded(evaluate.regression_metrics(predictions(spark, folder), keys=["model"]))


@query
def residual_analysis(spark, folder):
    return rounded(evaluate.residual_analysis(predictions(spark, folder), keys=["model"]))


@query
def error_statistics(spark, folder):
    return rounded(evaluate.error_statistics(predictions(spark, folder), keys=["model"]))


@query
def residual_outliers(spark, folder):
    return rounded(evaluate.residual_outliers(predictions(spark, folder), 2.0).select("seq", "residual"))


@query
def evaluation_report(spark, folder):
    return rounded(evaluate.evaluation_report(predictions(spark, folder)))


@query
def compare_models(spark, folder):
    rows = evaluate.regression_metrics(predictions(spark, folder), keys=["model"])
    return rounded(evaluate.compare_models(rows))


@query
def best_model(spark, folder):
    rows = evaluate.regression_metrics(predictions(spark, folder), keys=["model"])
    return rounded(evaluate.best_model(rows, "rmse"))


@query
def profile_from_summaries(spark, folder):
    """Ten days of readings profiled from daily summaries, and whether their estimates are within the error of the sketches."""
    rows, path = readings(spark, folder).select("timestamp", "aqi", "pm25"), new_folder(spark, "summaries")
    rollups.write_summaries(rollups.daily_summaries(rows, ["aqi", "pm25"]), path)
    first = rows.agg(F.min(F.to_date("timestamp"))).first()[0]
    span = F.to_date("timestamp").between(F.lit(first), F.date_add(F.lit(first), 9))
    made = rollups.profile_of(rollups.read_summaries(spark, path), last=F.date_add(F.lit(first), 9))
    values = rows.where(span).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("aqi", "pm25")])))
    asked = values.join(F.broadcast(made.select("feature", *rollups.QUARTILES)), "feature")  # a row for each column
    n, v = F.count("v"), F.col("v")
    near = [
        (F.count_if(v < F.col(q)) / n - 0.02 <= p) & (p <= F.count_if(v <= F.col(q)) / n + 0.02) for q, p in rollups.QUARTILES.items()
    ]
    checked = asked.groupBy("feature").agg((near[0] & near[1] & near[2]).alias("quartiles_near"), F.count_distinct("v").alias("exact"))
    both = made.join(checked, "feature")
    return rounded(
        both.select(
            "feature", "records", "missing", "missing_pct", "min", "max", "mean", "std",
            (F.abs(F.col("distinct") - F.col("exact")) <= 0.04 * F.col("exact") + 1).alias("distinct_near"), "quartiles_near",
        )
    )


# ------------------------------------------------------------------- models

_trained: dict[tuple, models.Trained] = {}


_prepared: dict[tuple, DataFrame] = {}


def _training_rows(spark, folder) -> DataFrame:
    """Written once per session and folder: splits, fits and scores read them many times, the windows run once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _prepared:
        rows = readings(spark, folder)
        _prepared[key] = write_out(features.prior_features(clean.clean(rows), bound=rows))
    return _prepared[key]


def _split_rows(spark, folder) -> DataFrame:
    """The training rows with their roles; the sort that finds the cut runs once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, "split")
    if key not in _prepared:
        _prepared[key] = splits.holdout_split(_training_rows(spark, folder), 0.2)
    return _prepared[key]


def _model(spark, folder, kind: str) -> models.Trained:
    """Trained once per session and folder, with the default parameters, on the earlier 80 percent."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _trained:
        _trained[key] = models.train(kind, _split_rows(spark, folder).where("role = 'train'"))
    return _trained[key]


def _scored(spark, folder, kind: str) -> DataFrame:
    rows = _split_rows(spark, folder).where("role = 'test'")
    scored = models.predict(_model(spark, folder, kind), rows)
    return scored.select("seq", "city", us(), "aqi", r6("prediction", "prediction"))


@query
def train_boosted_trees(spark, folder):
    scored = _scored(spark, folder, "boosted_trees")
    return rounded(evaluate.regression_metrics(scored, "aqi", "prediction"))


@query
def train_random_forest(spark, folder):
    scored = _scored(spark, folder, "random_forest")
    return rounded(evaluate.regression_metrics(scored, "aqi", "prediction"))


@query
def predict(spark, folder):
    return _scored(spark, folder, "boosted_trees")


@query
def cross_validate(spark, folder):
    return rounded(models.cross_validate("random_forest", _training_rows(spark, folder)))


@query
def evaluate_all(spark, folder):
    trained = {kind: _model(spark, folder, kind) for kind in models.KINDS}
    rows = _split_rows(spark, folder).where("role = 'test'")
    return rounded(models.evaluate_all(trained, rows))


@query
def model_feature_importance(spark, folder):
    return rounded(models.model_feature_importance(_model(spark, folder, "boosted_trees"), spark))


@query
def forecast_24h(spark, folder):
    trained = _model(spark, folder, "boosted_trees")
    rows = clean.clean(readings(spark, folder))
    held = splits.holdout_split(_training_rows(spark, folder), 0.2).where("role = 'test'")
    sigma = models.residual_sigma(trained, held)
    made = models.forecast_24h(trained, rows, sigma)
    return rounded(made.select("city", us(), "predicted_aqi", "upper_bound", "lower_bound"))


@query
def model_registry(spark, folder):
    store = registry.ModelRegistry(spark, new_folder(spark, "models"))
    for kind in models.KINDS:
        trained = _model(spark, folder, kind)
        row = evaluate.regression_metrics(_scored(spark, folder, kind), "aqi", "prediction").first()
        store.register(trained, kind, "v1", {m: row[m] for m in ("rmse", "mae", "r2")})
    row = evaluate.regression_metrics(_scored(spark, folder, "boosted_trees"), "aqi", "prediction", keys=["city"]).first()
    store.register(_model(spark, folder, "boosted_trees"), "boosted_trees", "v2", {m: row[m] for m in ("rmse", "mae", "r2")})
    store.delete("boosted_trees_v2")
    store.get(store.best("rmse")["model_id"])
    return store.stats()


#: Trees of one split over columns with few values, which have an exact answer in SQL: every threshold is a candidate.
SPLIT_ON = ["hour_of_day", "day_of_week"]
ONE_SPLIT = {
    "boosted_trees": {"maxDepth": 1, "maxIter": 1},
    "random_forest": {"maxDepth": 1, "numTrees": 3, "bootstrap": False, "minInstancesPerNode": 1},
}


def _one_split(spark, folder, kind: str) -> models.Trained:
    key = (spark.sparkContext.applicationId, folder, kind, "one split")
    if key not in _trained:
        rows = splits.holdout_split(_training_rows(spark, folder), 0.2).where("role = 'train'")
        _trained[key] = models.train(kind, rows, SPLIT_ON, parameters=ONE_SPLIT[kind])
    return _trained[key]


@query
def one_split_predictions(spark, folder):
    """Each row of the holdout, predicted by trees of one split of either kind."""
    rows = splits.holdout_split(_training_rows(spark, folder), 0.2).where("role = 'test'")
    made = None
    for kind in models.KINDS:
        part = models.predict(_one_split(spark, folder, kind), rows).select(F.lit(kind).alias("model"), "seq", r6("prediction", "prediction"))
        made = part if made is None else made.unionByName(part)
    return made


@query
def one_split_importance(spark, folder):
    """The column that a tree of one split uses has all the importance."""
    made = None
    for kind in models.KINDS:
        part = models.model_feature_importance(_one_split(spark, folder, kind), spark).select(F.lit(kind).alias("model"), "feature", "importance")
        made = part if made is None else made.unionByName(part)
    return rounded(made)


@query
def one_split_metrics(spark, folder):
    trained = {kind: _one_split(spark, folder, kind) for kind in models.KINDS}
    rows = splits.holdout_split(_training_rows(spark, folder), 0.2).where("role = 'test'")
    return rounded(models.evaluate_all(trained, rows))


@query
def one_split_folds(spark, folder):
    """Cross-validation of trees of one split, fold by fold."""
    return rounded(
        models.cross_validate("boosted_trees", _training_rows(spark, folder), columns=SPLIT_ON, parameters=ONE_SPLIT["boosted_trees"])
    )


@query
def train_all(spark, folder):
    """Both kinds of models trained twice, with cross-validation and without, and the history that was recorded of it."""
    rows, path = _training_rows(spark, folder), new_folder(spark, "runs")
    for folds in (3, None):
        trained = models.train_all(rows, ONE_SPLIT, folds, columns=SPLIT_ON)
        models.record_runs(spark, trained, path)
    return rounded(models.training_history(spark, path).drop("trained_at"))


@query
def training_summary(spark, folder):
    path = new_folder(spark, "runs")
    trained = {kind: _one_split(spark, folder, kind) for kind in models.KINDS}
    models.record_runs(spark, trained, path)
    models.record_runs(spark, {"boosted_trees": trained["boosted_trees"]}, path)
    made = models.training_summary(models.training_history(spark, path))
    return made.select("model", "runs", F.col("last_trained").isNotNull().alias("dated"), "best_rmse")


@query
def one_split_forecast(spark, folder):
    """The next day of each city by a tree of one split over the hour and the weekday."""
    trained = _one_split(spark, folder, "boosted_trees")
    held = splits.holdout_split(_training_rows(spark, folder), 0.2).where("role = 'test'")
    made = models.forecast_24h(trained, clean.clean(readings(spark, folder)), models.residual_sigma(trained, held))
    return rounded(made.select("city", us(), "predicted_aqi", "upper_bound", "lower_bound"))


@query
def predicted_rows(spark, folder):
    """Each row of the holdout has a finite prediction, for both kinds of models."""
    both = _scored(spark, folder, "boosted_trees").withColumn("kind", F.lit("boosted_trees"))
    both = both.union(_scored(spark, folder, "random_forest").withColumn("kind", F.lit("random_forest")))
    fine = F.abs("prediction") < float("inf")
    return both.groupBy("kind", "city").agg(F.count("*").alias("records"), F.count_if(fine).alias("predicted"))


@query
def fold_sizes(spark, folder):
    """Rows of the folds along time that cross validation trains and tests on."""
    made = splits.expanding_folds(_training_rows(spark, folder))
    return made.groupBy("fold", "role").agg(F.count("*").alias("records"))


@query
def importance_total(spark, folder):
    made = models.model_feature_importance(_model(spark, folder, "random_forest"), spark)
    return made.agg(F.count("*").alias("features"), r6(F.sum("importance"), "total"), (F.min("importance") >= 0).alias("none_negative"))


@query
def forecast_shape(spark, folder):
    """24 hours for each city, the prediction between bounds of one width."""
    trained = _model(spark, folder, "boosted_trees")
    held = splits.holdout_split(_training_rows(spark, folder), 0.2).where("role = 'test'")
    made = models.forecast_24h(trained, clean.clean(readings(spark, folder)), models.residual_sigma(trained, held))
    width = F.round(F.col("upper_bound") - F.col("predicted_aqi"), 6)
    inside = (F.col("lower_bound") <= F.col("predicted_aqi")) & (F.col("predicted_aqi") <= F.col("upper_bound"))
    return made.groupBy("city").agg(
        F.count("*").alias("hours"), F.count_distinct("timestamp").alias("stamps"), F.count_if(inside).alias("inside"),
        (F.max(width) == F.min(width)).alias("one_width"),
    )


@query
def registry_counts(spark, folder):
    """Two kinds registered, one of them twice, one version deleted."""
    return model_registry(spark, folder).select("grouping", "value", F.col("models").cast("long").alias("models"))


@query
def scaler_round_trip(spark, folder):
    """A scaler saved, loaded and used gives what the one that was fitted gives."""
    rows = table(spark, folder, "lineitem")
    fitted = scaling.scaler_fit(rows, MEASURES)
    path = new_folder(spark, "scaler")
    scaling.scaler_save(fitted, path)
    made = scaling.scaler_transform(rows, scaling.scaler_load(spark, path))
    return made.agg(*[r6(F.avg(c), f"{c}_mean") for c in MEASURES], F.count("*").alias("records"))


@query
def get_alert(spark, folder):
    """The alert of largest id, looked up by that id in the store."""
    stored, _, _ = _store(spark, folder)
    wanted = stored.agg(F.max("alert_id")).first()[0]
    return alert_store.get_alert(stored, wanted).select("alert_id", "city", "level", us())


@query
def fingerprint_of_shuffled(spark, folder):
    """The fingerprint of a table does not depend on the order or the partitions of its rows."""
    rows = readings(spark, folder)
    both = serving.table_fingerprint(rows).union(serving.table_fingerprint(rows.repartition(7, "station_id").orderBy(F.desc("seq"))))
    return both.agg(F.max("records").alias("records"), F.count_distinct("fingerprint").alias("fingerprints"))


# ---------------------------------------------------------------- streaming


@query
def validate_event(spark, folder):
    rows = readings(spark, folder)
    seq = F.col("seq")
    text = rows.select(
        "seq",
        F.when(seq % 31 != 0, F.col("city")).alias("city"),
        F.when(seq % 43 == 0, "soon").otherwise(F.unix_micros("timestamp").cast("string")).alias("timestamp"),
        F.when(seq % 41 == 0, "high").otherwise(F.col("aqi").cast("string")).alias("aqi"),
    )
    return scoring.validate_event(text).select("seq", "error")


@query
def pollutant_passthrough(spark, folder):
    rows = readings(spark, folder).select("seq", F.create_map(F.lit("pm25"), F.col("pm25")).alias("pollutants"))
    return messages.spread_pollutants(rows, POLLUTANTS)


@query
def assemble_features(spark, folder):
    rows = features.lag_rows(readings(spark, folder))
    made = scoring.assemble_features(rows, [*LAG_FEATURES, "absent"])
    parts = [r6(F.get("features", F.lit(i)).cast("double"), f"f{i}") for i in range(len(LAG_FEATURES) + 1)]
    return made.select("seq", *parts)


@query
def stream_dedup(spark, folder):
    """Instants of each city, of which several readings share some after rounding to the minute."""
    rows = reading_stream(spark, folder).withColumn("timestamp", F.date_trunc("minute", "timestamp"))
    made = run_to_end(spark, deduplicate_stream(rows), "dedup")
    return made.select("city", us())


@query
def stream_features_query(spark, folder):
    made = run_to_end(spark, stream_features(reading_stream(spark, folder)), "features")
    return rounded(
        made.select(
            "seq", "city", us(), *FEATURES, "buffer_size", us("oldest_timestamp"),
            F.col("time_span_hours"),
        )
    )


@query
def stream_state_stats(spark, folder):
    """What the state of the feature stream holds at its end. Cities that the watermark has left behind are gone from it."""
    path = new_folder(spark, "features")
    run_stream(spark, stream_features(reading_stream(spark, folder)), path)
    found = state_stats(spark, f"{path}/checkpoint")
    return rounded(found.select("city", "buffer_size", us("oldest_timestamp"), us("newest_timestamp"), "time_span_hours"))


@query
def stream_suppression_state(spark, folder):
    """The entries that the stream of alerts holds at its end; those older than the window have been removed by their timers."""
    path = new_folder(spark, "sent")
    run_stream(spark, suppress_repeats_stream(alerts.rule_alerts(reading_stream(spark, folder))), path)
    return state_entries(spark, f"{path}/checkpoint").select("city", "level", us("last_sent"))


@query
def stream_decode(spark, folder):
    """Messages as a file stream, decoded; good and bad events with their error."""
    path = new_folder(spark, "messages")
    _event_text(spark, folder).select("value").write.text(path)
    source = messages.read_messages(spark, "text", path=path)
    made = run_to_end(spark, messages.spread_pollutants(messages.decode_events(source)), "decoded")
    return made.select("city", us().cast("string").alias("timestamp_us"), "aqi", "pm25", "error")


@query
def stream_score(spark, folder):
    """The feature stream scored by a model as it runs."""
    trained = _model(spark, folder, "boosted_trees")
    scored = scoring.score(stream_features(reading_stream(spark, folder)), trained.model, trained.columns)
    made = run_to_end(spark, scored, "scores")
    return rounded(made.select("seq", "city", us(), "current_aqi", "predicted_aqi", "features_computed", "error"))


@query
def stream_score_one_split(spark, folder):
    """The feature stream scored by a tree of one split, whose predictions have an exact answer."""
    trained = _one_split(spark, folder, "boosted_trees")
    scored = scoring.score(stream_features(reading_stream(spark, folder)), trained.model, trained.columns)
    made = run_to_end(spark, scored, "scores")
    return rounded(made.select("seq", "city", us(), "current_aqi", "predicted_aqi", "features_computed", "error"))


@query
def stream_suppress_repeats(spark, folder):
    rows = reading_stream(spark, folder)
    sent = run_to_end(spark, suppress_repeats_stream(alerts.rule_alerts(rows)), "sent")
    return sent.select("seq", "city", "level", us())


def _latencies(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
    )


@query
def latency_stats(spark, folder):
    return rounded(scoring.latency_stats(_latencies(spark, folder), ["event_id"], limit_ms=100.0))


@query
def event_metrics(spark, folder):
    return rounded(scoring.event_metrics(_latencies(spark, folder), "timestamp"))


@query
def event_metrics_by_type(spark, folder):
    return rounded(scoring.event_metrics(_latencies(spark, folder), keys=["event_type"]))


@query
def event_metrics_windowed(spark, folder):
    """Tumbling hours of a stream: those that its watermark has closed, and those that it still holds."""
    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    rows = source.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
    )
    path = new_folder(spark, "windows")
    with fewer_partitions(spark):
        scoring.event_metrics_sink(rows, f"{path}/out", f"{path}/checkpoint", width="1 hour", availableNow=True).awaitTermination()
    still = scoring.open_windows(spark, f"{path}/checkpoint")
    closed = tables.read_or_empty(spark, f"{path}/out", still.schema, "batch").drop("batch")
    return rounded(
        closed.unionByName(still).select(
            us("window_start"), "event_count", "error_count", "error_rate", "min_latency_ms", "max_latency_ms",
            "mean_latency_ms", "p95_latency_ms", "p99_latency_ms",
        )
    )


@query
def latency_at_sink(spark, folder):
    """Readings through a stream that measures when they are written: how many have a latency, and in how many batches."""
    rows = reading_stream(spark, folder)
    rows = rows.select("seq", "city", "timestamp", "aqi", F.col("_metadata.file_modification_time").alias("ingest_time"))
    path = new_folder(spark, "latency")
    with fewer_partitions(spark):
        scoring.latency_sink(rows, f"{path}/out", f"{path}/checkpoint", availableNow=True).awaitTermination()
    made = scoring.finished_results(spark, f"{path}/out", rows.schema)
    found = scoring.latency_stats(made, ["seq"], limit_ms=3_600_000.0)
    return found.select(
        "events_processed",
        "events_exceeding_max",
        (F.col("min_latency_ms") > 0).alias("measured"),
        (F.col("p99_latency_ms") >= F.col("median_latency_ms")).alias("ordered"),
        F.lit(made.select("batch").distinct().count()).alias("batches"),
    )


@query
def stage_timing_stats(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds"))
    return rounded(scoring.stage_timing_stats(rows))


# ------------------------------------------------------------------- alerts


@query
def rule_alerts(spark, folder):
    made = alerts.rule_alerts(readings(spark, folder))
    return made.select(
        "seq", "alert_id", "alert_type", "city", "category", "level", us(), "current_aqi", "message", "recommendation",
        "threshold_min", "threshold_max",
    )


@query
def model_alerts(spark, folder):
    made = alerts.model_alerts(results(spark, folder))
    return rounded(
        made.select(
            "seq", "alert_id", "alert_type", "city", "level", "current_aqi", "predicted_aqi", "threshold",
            "recommendation", "message",
        )
    )


@query
def alert_preview(spark, folder):
    return rounded(alerts.alert_preview(results(spark, folder)).drop("city", "timestamp"))


@query
def suppress_repeats(spark, folder):
    made = alerts.suppress_repeats(alerts.rule_alerts(readings(spark, folder)))
    return made.select("seq", "city", "level", us())


@query
def suppression_state(spark, folder):
    rows = alerts.rule_alerts(readings(spark, folder))
    state = alerts.suppression_state(alerts.suppress_repeats(rows), now_of(readings(spark, folder)))
    return state.select("city", "level", us("last_sent"), r6("seconds_until_next", "seconds_until_next"), "expired")


@query
def suppression_totals(spark, folder):
    rows = alerts.rule_alerts(readings(spark, folder))
    state = alerts.suppression_state(alerts.suppress_repeats(rows), now_of(rows))
    return alerts.suppression_totals(state)


@query
def alert_flow(spark, folder):
    made = alerts.alert_flow(results(spark, folder))
    return rounded(made.select("seq", "alert_type", "city", "level", us(), "current_aqi", "predicted_aqi"))


@query
def alert_store_round_trip(spark, folder):
    path = new_folder(spark, "alerts")
    alert_store.store_alerts(alerts.alert_flow(results(spark, folder)), path)
    back = alert_store.read_alerts(spark, path)
    return rounded(
        back.select(
            "alert_id", "alert_type", "city", "level", "category", us(), "current_aqi", "predicted_aqi", "threshold",
            F.col("date").cast("string").alias("date"),
        )
    )


def _store(spark, folder) -> tuple[DataFrame, DataFrame, Column]:
    rows = alerts.suppress_repeats(alerts.rule_alerts(readings(spark, folder)))
    return rows, acks_of(rows), now_of(readings(spark, folder))


@query
def active_alerts(spark, folder):
    rows, acks, _ = _store(spark, folder)
    return alert_store.active_alerts(rows, acks).select("alert_id", "city", "level", us())


@query
def active_alerts_filtered(spark, folder):
    rows, acks, _ = _store(spark, folder)
    made = alert_store.active_alerts(rows, acks, city="error", level="warning")
    return made.select("alert_id", "city", "level", us())


@query
def alerts_by_city(spark, folder):
    rows, acks, now = _store(spark, folder)
    made = alert_store.alerts_by_city(rows, acks, "error", now, hours=24 * 7)
    return made.select("alert_id", "level", us(), "acknowledged", "acknowledged_by")


@query
def alerts_by_city_acknowledged(spark, folder):
    rows, acks, now = _store(spark, folder)
    made = alert_store.alerts_by_city(rows, acks, "view", now, hours=24 * 7, acknowledged=True)
    return made.select("alert_id", "level", us(), us("acknowledged_at"))


@query
def alerts_by_level(spark, folder):
    rows, _, now = _store(spark, folder)
    return alert_store.alerts_by_level(rows, "warning", now, hours=24 * 7).select("alert_id", "city", us())


@query
def acknowledge(spark, folder):
    """Ids of all readings are offered; only those of alerts are taken."""
    rows, _, now = _store(spark, folder)
    offered = alerts.rule_alerts(readings(spark, folder)).where(F.col("seq") % 3 == 0).select("alert_id")
    made = alert_store.acknowledgements(rows, offered, "operator", now)
    return made.select("alert_id", "acknowledged_by", us("acknowledged_at"))


@query
def alert_stats(spark, folder):
    rows, acks, now = _store(spark, folder)
    return alert_store.alert_stats(rows, acks, now, hours=24 * 7)


# ------------------------------------------------------------------ serving


@query
def latest_by_city(spark, folder):
    return serving.latest_by_city(readings(spark, folder)).select("seq", "city", us(), "aqi", "pm25")


@query
def history(spark, folder):
    rows = readings(spark, folder)
    return serving.history(rows, ["error", "view"], now_of(rows), days=7).select("city", us(), "aqi")


@query
def city_list(spark, folder):
    return serving.city_list(readings(spark, folder))


@query
def table_fingerprint(spark, folder):
    """The gold table, fingerprinted twice with different partitioning."""
    rows = readings(spark, folder)
    gold = features.build_gold(clean.clean(rows), bound=rows)
    gold = rounded(gold.drop("quality_flags"))
    first = serving.table_fingerprint(gold)
    second = serving.table_fingerprint(gold.repartition(7, "seq"))
    both = first.unionByName(second)
    return both.groupBy("records", "fingerprint").agg(F.count("*").alias("runs"))


QUERIES["stream_features"] = QUERIES.pop("stream_features_query")
