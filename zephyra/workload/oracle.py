"""The queries of ``queries.py`` as SQL for DuckDB, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from zephyra.schemas import (
    CATEGORIES,
    CRITICAL_FIELDS,
    LAG_FEATURES,
    LAG_OFFSETS,
    POLLUTANTS,
    PREDICTION_LEVELS,
    ROLLING_FEATURES,
    ROLLING_WINDOWS,
    SEASONS,
)
from zephyra.operators.models import MODEL_FEATURES
from zephyra.workload.views import READINGS_SQL

ORACLE: dict[str, str] = {}

STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r6(text: str, name: str | None = None) -> str:
    return f"round({text} + 1e-9, 6)" + (f" AS {name}" if name else "")


def r6s(names: list[str]) -> str:
    return ", ".join(r6(n, n) for n in names)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def readings(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}readings AS ({READINGS_SQL}) {body}"


HOURLY = ", hourly AS (SELECT *, date_trunc('hour', timestamp) AS _hour FROM readings)"
US = "epoch_us(timestamp) AS timestamp_us"
HOUR = 3_600_000_000

CATEGORY = "CASE " + " ".join(f"WHEN {{v}} BETWEEN {low} AND {high} THEN '{name}'" for name, low, high, *_ in CATEGORIES) + " END"
CONTINUOUS = (
    "CASE WHEN {v} < 0 OR {v} IS NULL THEN NULL "
    + " ".join(f"WHEN {{v}} <= {high} THEN '{name}'" for name, _, high, *_ in CATEGORIES[:-1])
    + f" ELSE '{CATEGORIES[-1][0]}' END"
)
CATEGORY_ROWS = ", ".join(
    f"({quote(n)}, {lo}, {hi}, {quote(level)}, {quote(color)}, {quote(advice)})" for n, lo, hi, level, color, advice in CATEGORIES
)
CATEGORY_TABLE = (
    f"(VALUES {CATEGORY_ROWS}) c(category, threshold_min, threshold_max, alert_level, color, recommendation)"
)


def by_prediction(value: str, position: int) -> str:
    parts = [f"WHEN {value} <= {row[0]} THEN {quote(row[position])}" for row in PREDICTION_LEVELS if row[0] is not None]
    return f"CASE {' '.join(parts)} WHEN {value} IS NOT NULL THEN {quote(PREDICTION_LEVELS[-1][position])} END"


def season_of(ts: str) -> str:
    parts = [f"WHEN month({ts}) IN ({', '.join(map(str, months))}) THEN '{name}'" for name, months in SEASONS.items()]
    return f"CASE {' '.join(parts)} END"


def calendar(ts: str) -> str:
    return (
        f"CAST(hour({ts}) AS INTEGER) AS hour_of_day, CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week, "
        f"CAST(month({ts}) AS INTEGER) AS month, CASE WHEN isodow({ts}) >= 6 THEN 1 ELSE 0 END AS is_weekend"
    )


# ------------------------------------------------------- sources and sinks

ORACLE["read_history_csv"] = readings(
    f"SELECT seq, city, {US}, CASE WHEN seq % 41 = 0 THEN NULL ELSE aqi END AS aqi, pm25 FROM readings"
)
ORACLE["coercion_counts"] = readings(
    """SELECT count(*) FILTER (seq % 43 = 0) AS invalid_timestamps,
    count(*) FILTER (seq % 41 = 0 OR aqi IS NULL) AS invalid_aqi,
    count(*) FILTER (seq % 43 = 0) AS unparsable_timestamps,
    count(*) FILTER (seq % 41 = 0) AS unparsable_aqi FROM readings"""
)
ORACLE["flatten_feed_json"] = readings(
    f"""SELECT seq, city, CASE WHEN reason IS NULL THEN CAST(epoch_us(timestamp) AS VARCHAR) END AS timestamp_us,
    CASE WHEN reason IS NULL THEN aqi END AS aqi,
    CASE WHEN reason IS NULL AND seq % 7 <> 0 THEN pm25 END AS pm25, CAST(NULL AS DOUBLE) AS no2, reason
    FROM (SELECT *, CASE WHEN seq % 41 = 0 THEN 'bad status' WHEN seq % 43 = 0 THEN 'no data'
          WHEN seq % 47 = 0 THEN 'invalid aqi' WHEN aqi IS NULL THEN 'missing aqi' END AS reason FROM readings)"""
)
DECODED = """SELECT seq, CASE WHEN seq % 41 <> 0 THEN city END AS city,
    CASE WHEN seq % 41 > 4 THEN CAST(epoch_us(timestamp) AS VARCHAR) WHEN seq % 41 = 4 THEN '5000000' END AS timestamp_us,
    CASE WHEN seq % 41 > 4 THEN aqi WHEN seq % 41 IN (1, 2, 3) THEN 7 END AS aqi, CASE WHEN seq % 41 > 4 THEN pm25 END AS pm25,
    CASE WHEN seq % 41 = 0 THEN 'invalid JSON' WHEN seq % 41 IN (1, 2, 3) THEN 'timestamp is not a number'
    WHEN seq % 41 = 4 THEN 'aqi is not a number' WHEN aqi IS NULL THEN 'missing aqi' END AS error FROM readings"""
ORACLE["decode_events"] = readings(DECODED)
ORACLE["stream_decode"] = readings(f"SELECT * EXCLUDE (seq) FROM ({DECODED})")
ORACLE["encode_and_route_events"] = readings(
    """SELECT 'readings_' || lower(city) AS topic, city AS key, seq, epoch_us(timestamp) AS timestamp, aqi
    FROM readings WHERE timestamp IS NOT NULL AND aqi IS NOT NULL"""
)
ORACLE["route_counts"] = readings(
    "SELECT city, count(aqi) AS sent, count(*) - count(aqi) AS failed FROM readings GROUP BY city"
)
ORACLE["bronze_round_trip"] = readings(
    f"""SELECT source, strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS records, count(aqi) AS known,
    {r6('sum(pm25)', 'pm25')}, CAST(0 AS DOUBLE) AS retrieval_time, (SELECT count(*) FROM readings) AS written
    FROM readings GROUP BY ALL"""
)

# ------------------------------------------------------------------ cleaning


def silver(key: str) -> str:
    """CTEs from ``readings`` or ``hourly`` to ``silver``."""
    source = "hourly" if key == "_hour" else "readings"
    return f"""{HOURLY}, first_rows AS (
        SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY city, {key} ORDER BY seq) = 1
    ), whole AS (SELECT * FROM first_rows WHERE city IS NOT NULL AND timestamp IS NOT NULL AND aqi BETWEEN 0 AND 500
    ), ordered AS (SELECT *, max(timestamp) OVER (PARTITION BY city ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM whole
    ), silver AS (SELECT * EXCLUDE (earlier) FROM ordered WHERE earlier IS NULL OR timestamp >= earlier)"""


ORACLE["layer_round_trip"] = readings(
    f"{silver('timestamp')} SELECT seq, city, {US}, aqi, strftime(timestamp, '%Y-%m-%d') AS date FROM silver WHERE city = 'error'"
)
ORACLE["gate_counts"] = readings(
    "SELECT count(*) AS records, "
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in CRITICAL_FIELDS)
    + ", count(*) FILTER (aqi NOT BETWEEN 0 AND 500) AS out_of_range FROM readings"
)
ORACLE["dedup"] = readings(
    f"""{HOURLY} SELECT seq, city, {US}, aqi, pm25 FROM hourly h
    WHERE seq = (SELECT min(seq) FROM hourly g WHERE g.city = h.city AND g._hour = h._hour)"""
)
ORACLE["drop_missing"] = readings(
    f"SELECT seq, city, {US}, aqi FROM readings WHERE city IS NOT NULL AND timestamp IS NOT NULL AND aqi IS NOT NULL"
)
ORACLE["filter_range"] = readings(f"SELECT seq, city, {US}, aqi FROM readings WHERE aqi >= 0 AND aqi <= 500")
LATE = "coalesce(timestamp < max(timestamp) OVER (PARTITION BY city ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"
ORACLE["out_of_order"] = readings(f"SELECT seq, city, {US}, {LATE} AS late FROM readings")
ORACLE["out_of_order_previous"] = readings(
    f"SELECT seq, city, {US}, coalesce(timestamp < lag(timestamp) OVER (PARTITION BY city ORDER BY seq), false) AS late FROM readings"
)
ORACLE["quality_flags"] = readings(
    f"""{HOURLY} SELECT seq, city, {US}, concat_ws(',',
    CASE WHEN city IS NULL OR timestamp IS NULL OR aqi IS NULL THEN 'missing' END,
    CASE WHEN aqi NOT BETWEEN 0 AND 500 THEN 'out_of_range' END,
    CASE WHEN seq > min(seq) OVER (PARTITION BY city, _hour) THEN 'duplicate' END,
    CASE WHEN {LATE} THEN 'out_of_order' END) AS flags FROM hourly"""
)
ORACLE["clean_silver"] = readings(
    f"{silver('_hour')} SELECT seq, city, {US}, aqi, pm25, CAST(0 AS INTEGER) AS flags FROM silver"
)
ORACLE["rejection_counts"] = readings(
    f"""{silver('_hour')} SELECT 'duplicate' AS reason, (SELECT count(*) FROM hourly) - (SELECT count(*) FROM first_rows) AS records
    UNION ALL SELECT 'missing', count(*) FROM first_rows WHERE city IS NULL OR timestamp IS NULL OR aqi IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'out_of_range', count(*) FROM first_rows WHERE aqi NOT BETWEEN 0 AND 500 HAVING count(*) > 0
    UNION ALL SELECT 'out_of_order', (SELECT count(*) FROM whole) - count(*) FROM silver HAVING (SELECT count(*) FROM whole) > count(*)
    UNION ALL SELECT 'valid', count(*) FROM silver"""
)
ORACLE["aqi_category"] = readings(
    f"SELECT seq, aqi, {CATEGORY.format(v='aqi')} AS strict, {CONTINUOUS.format(v='aqi')} AS continuous FROM readings"
)
ORACLE["category_attributes"] = readings(
    f"""SELECT seq, category, CAST(threshold_min AS DOUBLE) AS threshold_min, CAST(threshold_max AS DOUBLE) AS threshold_max,
    alert_level, color, recommendation FROM (SELECT seq, {CATEGORY.format(v='aqi')} AS category FROM readings) LEFT JOIN {CATEGORY_TABLE} USING (category)"""
)

# -------------------------------------------------------------- data quality

ORACLE["missing_by_column"] = readings(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM readings"
        for c in ("seq", "city", "station_id", "timestamp", "aqi", "pm25", "source")
    )
    + ") WHERE missing > 0"
)
ORACLE["out_of_range_count"] = readings(
    "SELECT 'aqi' AS \"column\", count(*) AS out_of_range FROM readings WHERE aqi < 0 OR aqi > 500"
)
ORACLE["duplicate_count"] = readings(
    f"{HOURLY} SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT city, _hour FROM hourly)) AS duplicates FROM hourly"
)
SCORE = f"""{HOURLY}, t AS (SELECT count(*) AS n, count(*) FILTER (aqi IS NULL) AS missing,
    count(*) FILTER (aqi < 0 OR aqi > 500) AS outside,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT city, _hour FROM hourly)) AS copies,
    (SELECT count(*) FROM (SELECT DISTINCT city, _hour FROM hourly WHERE aqi BETWEEN 0 AND 500)) AS kept FROM hourly
    ), scored AS (SELECT *, round((n - missing - outside - copies) / n * 100, 2) AS score FROM t)"""
ORACLE["quality_score"] = readings(
    f"{SCORE} SELECT n AS total_records, missing + outside + copies AS issues, score AS quality_score FROM scored"
)
ORACLE["quality_score_rows"] = readings(
    f"{SCORE} SELECT n AS total_records, n - kept AS issues, round(kept / n * 100, 2) AS quality_score FROM scored"
)
ALERTS = """SELECT 'warning' AS level, printf('Quality score below 80%%: %.2f%%', score) AS message FROM scored WHERE score < 80
    UNION ALL SELECT 'warning', 'Found ' || missing || ' missing values in 1 columns' FROM scored WHERE missing > 0
    UNION ALL SELECT 'warning', 'Found ' || outside || ' out-of-range values' FROM scored WHERE outside > 0
    UNION ALL SELECT 'info', 'Found ' || copies || ' duplicate records' FROM scored WHERE copies > 0"""
ORACLE["quality_alerts"] = readings(f"{SCORE} {ALERTS}")
ADVICE = """SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, text AS recommendation FROM (
    SELECT 1 AS o, 'Quality score is below 80%. Consider investigating data sources and validation rules.' AS text FROM scored WHERE score < 80
    UNION ALL SELECT 2, 'Address missing values in 1 columns. Consider imputation or data source verification.' FROM scored WHERE missing > 0
    UNION ALL SELECT 3, 'Out-of-range values detected. Verify data source and validation thresholds.' FROM scored WHERE outside > 0
    UNION ALL SELECT 4, 'Duplicate records detected. Implement deduplication in ETL pipeline.' FROM scored WHERE copies > 0
    UNION ALL SELECT 5, 'Data quality is good. Continue monitoring.' FROM scored
        WHERE score >= 80 AND missing = 0 AND outside = 0 AND copies = 0)"""
ORACLE["quality_recommendations"] = readings(f"{SCORE} {ADVICE}")
READING_KINDS = {
    "seq": "bigint", "city": "string", "station_id": "bigint", "timestamp": "timestamp", "aqi": "double", "pm25": "double",
    "source": "string",
}
PROFILE = "UNION ALL " + " UNION ALL ".join(
    f"SELECT 'column', '{c}', measure, value, '{kind}' FROM (SELECT CAST(count(*) - count({c}) AS DOUBLE) AS missing, "
    f'(count(*) - count({c})) * 100.0 / count(*) AS missing_pct, CAST(count(DISTINCT {c}) AS DOUBLE) AS "distinct" FROM readings) '
    f'UNPIVOT (value FOR measure IN (missing, missing_pct, "distinct"))'
    for c, kind in READING_KINDS.items()
)
ORACLE["column_profile"] = readings(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {r6(f'(count(*) - count({c})) / count(*) * 100', 'missing_pct')}, "
        f"count(DISTINCT {c}) AS \"distinct\", '{kind}' AS type FROM readings"
        for c, kind in READING_KINDS.items()
    )
)
GROUPS = """SELECT city, count(*) AS records, count(*) - count(aqi) AS missing_aqi, min(aqi) AS min_aqi, max(aqi) AS max_aqi
    FROM readings GROUP BY city"""
ORACLE["group_profile"] = readings(GROUPS)
PLAIN_SCORE = SCORE.replace(HOURLY, "").replace("_hour", "timestamp").replace("hourly", "readings")
ORACLE["quality_report"] = readings(
    f"""{PLAIN_SCORE}, g AS ({GROUPS}), long AS (
    SELECT 'summary' AS section, 'table' AS item, measure, value, CAST(NULL AS VARCHAR) AS text FROM (
        SELECT CAST(n AS DOUBLE) AS total_records, CAST(score AS DOUBLE) AS quality_score, CAST(missing AS DOUBLE) AS missing_values,
        CAST(outside AS DOUBLE) AS out_of_range, CAST(copies AS DOUBLE) AS duplicates FROM scored)
        UNPIVOT (value FOR measure IN (total_records, quality_score, missing_values, out_of_range, duplicates))
    UNION ALL SELECT 'city', city, measure, value, NULL FROM (
        SELECT city, CAST(records AS DOUBLE) AS records, CAST(missing_aqi AS DOUBLE) AS missing_aqi, min_aqi, max_aqi FROM g)
        UNPIVOT (value FOR measure IN (records, missing_aqi, min_aqi, max_aqi))
    {PROFILE}
    UNION ALL SELECT 'alert', level, 'value', 1.0, message FROM ({ALERTS})
    UNION ALL SELECT 'recommendation', CAST(position AS VARCHAR), 'value', 1.0, recommendation FROM ({ADVICE}))
    SELECT section, item, measure, {r6('value', 'value')}, text FROM long"""
)
ORACLE["pipeline_metrics"] = readings(
    f"""{silver('timestamp')}, {PLAIN_SCORE[2:]}, long AS (
    SELECT 'bronze_ingested' AS measure, CAST(n AS DOUBLE) AS value FROM scored
    UNION ALL SELECT 'valid_records', count(*) FROM silver
    UNION ALL SELECT 'rejected_records', (SELECT n FROM scored) - count(*) FROM silver
    UNION ALL SELECT 'gold_stored', count(*) FROM silver
    UNION ALL SELECT 'quality_score', score FROM scored
    UNION ALL SELECT 'within_target', 1)
    SELECT 'run' AS run_id, measure, {r6('value', 'value')} FROM long"""
)

# --------------------------------------------------------------- features


def lag_columns(over: str, column: str = "aqi") -> str:
    return ", ".join(f"lag({column}, {n}) OVER ({over}) AS {column}_lag_{n}h" for n in LAG_OFFSETS)


def rolling_columns(over: str, frame: str, std: str = "stddev_samp") -> str:
    """``frame`` is a format over ``{n}``."""
    fns = {**STATS, "std": std}
    return ", ".join(
        f"{fn}(aqi) OVER ({over} {frame.format(n=n, us=n * HOUR, inner=n * HOUR - 1, rows=n - 1)}) AS aqi_{stat}_{n}h"
        for n in ROLLING_WINDOWS
        for stat, fn in fns.items()
    )


BY_TIME = "PARTITION BY city ORDER BY timestamp, seq"
BY_US = "PARTITION BY city ORDER BY epoch_us(timestamp)"
ROWS = "ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW"
CLOSED = "RANGE BETWEEN {us} PRECEDING AND CURRENT ROW"
OPEN = "RANGE BETWEEN {inner} PRECEDING AND 1 PRECEDING"
ASOF = ", ".join(
    f"last_value(aqi IGNORE NULLS) OVER ({BY_US} RANGE BETWEEN UNBOUNDED PRECEDING AND {n * HOUR} PRECEDING) AS aqi_lag_{n}h"
    for n in LAG_OFFSETS
)


def feature_query(columns: str, names: list[str], source: str = "readings", ctes: str = "", more: str = "") -> str:
    more = f", {more}" if more else ""
    return readings(
        f"{ctes} SELECT seq, city, timestamp_us, {r6s(names)}{more} FROM (SELECT *, {US}, {columns} FROM {source})"
    )


ORACLE["lag_rows"] = feature_query(lag_columns(BY_TIME), LAG_FEATURES)
ORACLE["lag_rows_by_station"] = feature_query(
    lag_columns("PARTITION BY station_id ORDER BY timestamp, seq"), LAG_FEATURES
)
ORACLE["rolling_rows"] = feature_query(rolling_columns(BY_TIME, ROWS), ROLLING_FEATURES)
ORACLE["rolling_range"] = feature_query(rolling_columns(BY_US, CLOSED), ROLLING_FEATURES)
ORACLE["asof_lags"] = feature_query(ASOF, LAG_FEATURES)
ORACLE["trailing_stats"] = feature_query(rolling_columns(BY_US, OPEN, "stddev_pop"), ROLLING_FEATURES)
EVENT_COLUMNS = f"{ASOF}, {rolling_columns(BY_US, OPEN, 'stddev_pop')}, {calendar('timestamp')}, {season_of('timestamp')} AS season"
CALENDAR = "hour_of_day, day_of_week, month, is_weekend, season"
ORACLE["event_features"] = feature_query(EVENT_COLUMNS, [*LAG_FEATURES, *ROLLING_FEATURES], more=CALENDAR)
BUFFER = f"OVER ({BY_US} RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW)"
ORACLE["window_state_stats"] = readings(
    f"""SELECT DISTINCT city, {US}, count(*) {BUFFER} AS buffer_size, epoch_us(min(timestamp) {BUFFER}) AS oldest_timestamp_us,
    epoch_us(timestamp) AS newest_timestamp_us,
    {r6(f'(epoch_us(timestamp) - epoch_us(min(timestamp) {BUFFER})) / 3.6e9', 'time_span_hours')} FROM readings"""
)
ORACLE["stream_features"] = feature_query(
    f"{EVENT_COLUMNS}, count(*) {BUFFER} AS buffer_size, epoch_us(min(timestamp) {BUFFER}) AS oldest_timestamp_us",
    [*LAG_FEATURES, *ROLLING_FEATURES],
    source="(FROM readings WHERE aqi IS NOT NULL)",
    more=f"{CALENDAR}, buffer_size, oldest_timestamp_us, {r6('(timestamp_us - oldest_timestamp_us) / 3.6e9', 'time_span_hours')}",
)
# a city leaves the state of the stream when the watermark, an hour behind the newest reading, is beyond its window and lateness
ORACLE["stream_state_stats"] = readings(
    f"""SELECT city, buffer_size, oldest_timestamp_us, {US.replace('timestamp_us', 'newest_timestamp_us')},
    {r6('(epoch_us(timestamp) - oldest_timestamp_us) / 3.6e9', 'time_span_hours')} FROM (
        SELECT DISTINCT city, timestamp, count(*) {BUFFER} AS buffer_size, epoch_us(min(timestamp) {BUFFER}) AS oldest_timestamp_us,
        max(timestamp) OVER (PARTITION BY city) AS newest, max(timestamp) OVER () AS latest FROM readings WHERE aqi IS NOT NULL)
    WHERE timestamp = newest AND newest + INTERVAL 26 HOUR > latest"""
)
ORACLE["temporal_parts"] = readings(
    f"""SELECT seq, {calendar('timestamp')}, CAST(dayofweek(timestamp) AS INTEGER) AS sunday_day,
    CASE WHEN dayofweek(timestamp) IN (5, 6) THEN 1 ELSE 0 END AS sunday_weekend FROM readings"""
)
ORACLE["season"] = f"SELECT o_orderkey AS seq, {season_of('o_orderdate')} AS season FROM orders"


def filled(c: str, over: str = BY_TIME) -> str:
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"""


ORACLE["fill_missing"] = readings(
    f"SELECT seq, city, {US}, {filled('aqi')} AS aqi, {filled('pm25')} AS pm25 FROM readings"
)
GOLD = f"{lag_columns(BY_TIME)}, {rolling_columns(BY_TIME, ROWS)}, {calendar('timestamp')}, {season_of('timestamp')} AS season"
ORACLE["build_gold"] = feature_query(
    GOLD, ["aqi", "pm25", *LAG_FEATURES, *ROLLING_FEATURES], "silver", silver("_hour"), CALENDAR
)
ORACLE["build_gold_range"] = feature_query(
    GOLD.replace(rolling_columns(BY_TIME, ROWS), rolling_columns(BY_US, CLOSED)),
    ["aqi", "pm25", *LAG_FEATURES, *ROLLING_FEATURES],
    "silver",
    silver("_hour"),
    CALENDAR,
)
ORACLE["scaler_fit"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'avg({c})', 'mean')}, {r6(f'var_pop({c})', 'var')}, {r6(f'stddev_pop({c})', 'scale')} FROM lineitem"
    for c in MEASURES
)
ORACLE["scaler_transform"] = (
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(r6(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)", c) for c in MEASURES)
    + " FROM lineitem"
)

# ---------------------------------------------------------------- profiling


def stats_of(source: str, columns: list[str], measures: dict[str, str]) -> str:
    """``feature, stat, value``; measures are formats over ``{c}``."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{stat}' AS stat, {r6(f'CAST({text.format(c=c)} AS DOUBLE)', 'value')} FROM {source}"
        for c in columns
        for stat, text in measures.items()
    )


MOMENTS = {
    "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
    "skewness": "skewness({c})", "kurtosis": "kurtosis({c})",
}
ORACLE["feature_statistics"] = stats_of(
    "lineitem",
    MEASURES,
    {
        **MOMENTS, "count": "count({c})", "null_count": "count(*) - count({c})",
        "null_percentage": "(count(*) - count({c})) * 100.0 / count(*)",
        "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)",
    },
)
ORACLE["feature_statistics_sparse"] = ORACLE["feature_statistics"] + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'nothing', '{stat}', {value}"
    for stat, value in {
        **dict.fromkeys([*MOMENTS, "25%", "50%", "75%"], "NULL"), "count": "0.0",
        "null_count": "(SELECT CAST(count(*) AS DOUBLE) FROM lineitem)", "null_percentage": "100.0",
    }.items()
)
DISTRIBUTIONS = stats_of(
    "readings",
    ["aqi", "pm25"],
    {**MOMENTS, "q25": "quantile_cont({c}, 0.25)", "median": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)"},
)
ORACLE["feature_distributions"] = readings(DISTRIBUTIONS)
ORACLE["correlation_matrix"] = " UNION ALL ".join(
    [
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({a}, {b})' if a != b else '1.0', 'r')} FROM lineitem"
        for a in MEASURES
        for b in MEASURES
    ]
    + [
        f"SELECT '{a}', '{b}', CAST(NULL AS DOUBLE)"
        for a in [*MEASURES, "constant"]
        for b in [*MEASURES, "constant"]
        if "constant" in (a, b)
    ]
).replace(
    "round(1.0 + 1e-9, 6) AS r FROM lineitem", "CAST(1.0 AS DOUBLE) AS r"
)
TARGET = "WITH t AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ("1.0" if c == "l_extendedprice" else f"corr({c}, l_extendedprice)") + " AS r FROM lineitem"
    for c in MEASURES
).replace("1.0 AS r FROM lineitem", "CAST(1.0 AS DOUBLE) AS r") + ")"
ORACLE["target_correlations"] = f"{TARGET} SELECT feature, {r6('r', 'r')} FROM t"
ORACLE["feature_importance_corr"] = (
    f"{TARGET} SELECT feature, {r6('(abs(r) - min(abs(r)) OVER ()) / (max(abs(r)) OVER () - min(abs(r)) OVER ())', 'importance')} FROM t"
)
IQR = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, seq, {c} AS value FROM readings, (SELECT quantile_cont({c}, 0.25) AS q1,
    quantile_cont({c}, 0.75) AS q3 FROM readings) WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"""
    for c in ("aqi", "pm25")
)
ORACLE["outliers_iqr"] = readings(IQR)
ORACLE["outliers_zscore"] = readings(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, seq, {c} AS value FROM readings, (SELECT avg({c}) AS m, stddev_samp({c}) AS s
        FROM readings) WHERE abs(({c} - m) / s) > 3"""
        for c in ("aqi", "pm25")
    )
)
ORACLE["group_consistency"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {key} AS l_returnflag, '{scope}' AS scope, {r6(f'avg({c})', 'mean')},
    {r6(f'stddev_samp({c})', 'std')}, count(*) AS count FROM lineitem GROUP BY {group}"""
    for c in MEASURES
    for key, scope, group in (("l_returnflag", "group", "l_returnflag"), ("CAST(NULL AS VARCHAR)", "global", "()"))
)
PAIR_COLUMNS = ["l_extendedprice", "l_discount", "l_tax", "net", "double_tax"]
ORACLE["high_correlation_pairs"] = (
    "WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, l_tax * 2 AS double_tax FROM lineitem), p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM t"
        for i, a in enumerate(PAIR_COLUMNS)
        for b in PAIR_COLUMNS[i + 1 :]
    )
    + f") SELECT feature_a, feature_b, {r6('r', 'r')} FROM p WHERE abs(r) > 0.7"
)
ORACLE["low_variance"] = (
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM lineitem" for c in MEASURES)
    + f" UNION ALL SELECT 'constant', 0.0) SELECT feature, {r6('variance', 'variance')} FROM v WHERE variance < 0.01"
)
TWO = "(SELECT corr(aqi, pm25) FROM readings)"
ORACLE["analysis_report"] = readings(
    f""", statistics AS ({stats_of('readings', ['aqi', 'pm25'], {
        **MOMENTS, 'count': 'count({c})', 'null_count': 'count(*) - count({c})',
        'null_percentage': '(count(*) - count({c})) * 100.0 / count(*)',
        '25%': 'quantile_cont({c}, 0.25)', '50%': 'quantile_cont({c}, 0.5)', '75%': 'quantile_cont({c}, 0.75)'})}),
    distributions AS ({DISTRIBUTIONS}), iqr AS ({IQR}), long AS (
    SELECT 'summary' AS section, 'aqi' AS feature, 'records' AS item, CAST(count(*) AS DOUBLE) AS value FROM readings
    UNION ALL SELECT 'statistics', feature, stat, value FROM statistics
    UNION ALL SELECT 'distributions', feature, stat, value FROM distributions
    UNION ALL SELECT 'target_correlations', 'aqi', NULL, 1.0
    UNION ALL SELECT 'target_correlations', 'pm25', NULL, {TWO}
    UNION ALL SELECT 'importance', 'aqi', NULL, 1.0
    UNION ALL SELECT 'importance', 'pm25', NULL, 0.0
    UNION ALL SELECT 'correlation_matrix', 'aqi', 'aqi', 1.0
    UNION ALL SELECT 'correlation_matrix', 'pm25', 'pm25', 1.0
    UNION ALL SELECT 'correlation_matrix', 'aqi', 'pm25', {TWO}
    UNION ALL SELECT 'correlation_matrix', 'pm25', 'aqi', {TWO}
    UNION ALL SELECT 'outliers', feature, CAST(seq AS VARCHAR), value FROM iqr)
    SELECT section, feature, item, {r6('value', 'value')} FROM long"""
)

# ------------------------------------------------------------------- splits

NUMBERED = """WITH n AS (SELECT o_orderkey AS seq, o_orderdate AS timestamp,
    row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders),
    f AS (SELECT fold, total // 4 AS size, size * fold AS cut, size * (fold + 1) AS finish FROM (SELECT max(total) AS total FROM n),
    (VALUES (1), (2), (3)) v(fold))"""
FOLDS = f"""{NUMBERED}, folds AS (SELECT fold, CASE WHEN i < cut THEN 'train' ELSE 'test' END AS role, seq, timestamp
    FROM n, f WHERE i < finish)"""
SNAPPED = f"""{NUMBERED}, cuts AS (SELECT fold, (SELECT timestamp FROM n WHERE i = cut) AS cut,
    (SELECT timestamp FROM n WHERE i = finish) AS finish FROM f), folds AS (
    SELECT fold, CASE WHEN timestamp < cut THEN 'train' ELSE 'test' END AS role, seq, timestamp FROM n, cuts
    WHERE finish IS NULL OR timestamp < finish)"""
LEAK = """SELECT fold, epoch_us(a) AS max_train_us, epoch_us(b) AS min_test_us, a < b AS no_leakage FROM (
    SELECT fold, max(timestamp) FILTER (role = 'train') AS a, min(timestamp) FILTER (role = 'test') AS b FROM folds GROUP BY fold)"""
ORACLE["expanding_folds"] = f"{FOLDS} SELECT CAST(fold AS INTEGER) AS fold, role, seq FROM folds"
ORACLE["expanding_folds_time"] = f"{SNAPPED} SELECT CAST(fold AS INTEGER) AS fold, role, seq FROM folds"
ORACLE["holdout_split"] = (
    f"{NUMBERED} SELECT seq, CASE WHEN i < CAST(floor(total * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM n"
)
ORACLE["holdout_split_null_time"] = """WITH o AS (SELECT o_orderkey AS seq,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS timestamp FROM orders),
    n AS (SELECT seq, row_number() OVER (ORDER BY timestamp NULLS FIRST, seq) - 1 AS i, count(*) OVER () AS total FROM o)
    SELECT seq, CASE WHEN i < CAST(floor(total * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM n"""
ORACLE["leakage_check"] = f"{FOLDS} {LEAK}"
ORACLE["leakage_check_time"] = f"{SNAPPED} {LEAK}"

# --------------------------------------------------------------- evaluation

PREDICTIONS = """WITH p AS (SELECT event_id AS seq, event_type AS model, value AS y, value - (value * 0.9 + 5) AS e,
    abs(value - (value * 0.9 + 5)) AS a, CASE WHEN value <> 0 THEN abs(value - (value * 0.9 + 5)) / abs(value) * 100 END AS pct FROM events)"""


def metrics(group: str) -> str:
    return f"""SELECT {group}, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(a) AS mae,
    1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(pct) AS mape FROM p GROUP BY ALL"""


def residuals(group: str) -> str:
    return f"""SELECT {group}, avg(e) AS residual_mean, stddev_pop(e) AS residual_std, min(e) AS residual_min,
    max(e) AS residual_max, avg(((e - m) / s) ** 3) AS residual_skewness, kurtosis_pop(e) AS residual_kurtosis
    FROM (SELECT *, avg(e) OVER (PARTITION BY {group}) AS m, stddev_pop(e) OVER (PARTITION BY {group}) AS s FROM p) GROUP BY ALL"""


def errors(group: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {group}, '{name}' AS measure, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max,
        quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM p GROUP BY ALL"""
        for name, c in (("error", "a"), ("error_pct", "pct"))
    )


METRIC_NAMES = ["rmse", "mae", "r2", "mape"]
RESIDUAL_NAMES = [f"residual_{s}" for s in ("mean", "std", "min", "max", "skewness", "kurtosis")]
ERROR_NAMES = ["mean", "std", "min", "max", "median", "q25", "q75"]
ORACLE["regression_metrics"] = f"{PREDICTIONS}, m AS ({metrics('model')}) SELECT model, n, {r6s(METRIC_NAMES)} FROM m"
ORACLE["compare_models"] = ORACLE["regression_metrics"]
ORACLE["best_model"] = ORACLE["regression_metrics"] + " WHERE rmse = (SELECT min(rmse) FROM m)"
ORACLE["residual_analysis"] = f"{PREDICTIONS}, m AS ({residuals('model')}) SELECT model, {r6s(RESIDUAL_NAMES)} FROM m"
ORACLE["error_statistics"] = f"{PREDICTIONS}, m AS ({errors('model')}) SELECT model, measure, {r6s(ERROR_NAMES)} FROM m"
ORACLE["residual_outliers"] = (
    f"{PREDICTIONS} SELECT seq, {r6('e', 'residual')} FROM p WHERE abs(e) > 2 * (SELECT stddev_pop(e) FROM p)"
)
ORACLE["evaluation_report"] = f"""{PREDICTIONS}, m AS ({metrics('1 AS g')}), r AS ({residuals('1').replace('SELECT 1,', 'SELECT 1 AS g,')}),
    x AS ({errors('1 AS g')}), long AS (
    SELECT 'metrics' AS section, name, value FROM (SELECT {', '.join(METRIC_NAMES)} FROM m) UNPIVOT (value FOR name IN ({', '.join(METRIC_NAMES)}))
    UNION ALL SELECT 'residuals', name, value FROM (SELECT * EXCLUDE (g) FROM r) UNPIVOT (value FOR name IN ({', '.join(RESIDUAL_NAMES)}))
    UNION ALL SELECT measure, name, value FROM (SELECT * EXCLUDE (g) FROM x) UNPIVOT (value FOR name IN ({', '.join(ERROR_NAMES)}))
    UNION ALL SELECT 'size', 'n_samples', count(*) FROM p
    UNION ALL SELECT 'size', 'n_outliers', count(*) FROM p WHERE abs(e) > 2 * (SELECT stddev_pop(e) FROM p))
    SELECT section, name, {r6('value', 'value')} FROM long"""

# ---------------------------------------------------------------- streaming

ORACLE["validate_event"] = readings(
    """SELECT seq, CASE WHEN seq % 31 = 0 THEN 'missing city' WHEN seq % 41 <> 0 AND aqi IS NULL THEN 'missing aqi'
    WHEN seq % 43 = 0 THEN 'timestamp is not a number' WHEN seq % 41 = 0 THEN 'aqi is not a number' END AS error FROM readings"""
)
ORACLE["pollutant_passthrough"] = readings(
    "SELECT seq, " + ", ".join("pm25" if p == "pm25" else f"CAST(NULL AS DOUBLE) AS {p}" for p in POLLUTANTS) + " FROM readings"
)
ORACLE["assemble_features"] = readings(
    "SELECT seq, "
    + ", ".join(r6(f"CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE)", f"f{i}") for i, c in enumerate(LAG_FEATURES))
    + f", CAST(0 AS DOUBLE) AS f{len(LAG_FEATURES)} FROM (SELECT seq, {lag_columns(BY_TIME)} FROM readings)"
)


def latency(extra: str, source: str, group: str = "") -> str:
    return f"""SELECT {group} count(*) AS event_count, count(*) FILTER (event_type = 'error') AS error_count,
    {r6("count(*) FILTER (event_type = 'error') / count(*)", 'error_rate')}, {r6('min(value)', 'min_latency_ms')},
    {r6('max(value)', 'max_latency_ms')}, {r6('avg(value)', 'mean_latency_ms')}{extra} FROM {source}"""


PERCENTILES = (
    f", {r6('quantile_cont(value, 0.95)', 'p95_latency_ms')}, {r6('quantile_cont(value, 0.99)', 'p99_latency_ms')}"
)
ORACLE["latency_stats"] = f"""WITH recent AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000)
    SELECT (SELECT count(*) FROM events) AS events_processed, (SELECT count(*) FROM events WHERE value > 100) AS events_exceeding_max,
    {r6('min(value)', 'min_latency_ms')}, {r6('max(value)', 'max_latency_ms')}, {r6('avg(value)', 'mean_latency_ms')},
    {r6('quantile_cont(value, 0.5)', 'median_latency_ms')}{PERCENTILES} FROM recent"""
ORACLE["event_metrics"] = latency(
    f", {r6('count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts)))', 'throughput_per_second')}{PERCENTILES}", "events"
)
ORACLE["event_metrics_by_type"] = latency(PERCENTILES, "events GROUP BY event_type", "event_type,")
ORACLE["event_metrics_windowed"] = latency(
    f", {r6('quantile_cont(value, 0.95)', 'p95_latency_ms')}, {r6('quantile_cont(value, 0.99)', 'p99_latency_ms')}",
    "events GROUP BY date_trunc('hour', ts)",
    "epoch_us(date_trunc('hour', ts)) AS window_start_us,",
)
ORACLE["latency_at_sink"] = readings(
    """SELECT count(*) AS events_processed, 0 AS events_exceeding_max, true AS measured, true AS ordered, 4 AS batches
    FROM readings WHERE aqi IS NOT NULL"""
)
ORACLE["stage_timing_stats"] = f"""SELECT event_type AS operation, count(*) AS count, {r6('min(value)', 'min_seconds')},
    {r6('max(value)', 'max_seconds')}, {r6('avg(value)', 'mean_seconds')}, {r6('sum(value)', 'total_seconds')} FROM events GROUP BY event_type"""

# ------------------------------------------------------------------- alerts


def alert_id(kind: str) -> str:
    return f"sha256(concat_ws('|', '{kind}', city, level, epoch_us(timestamp)))"


RULES = f""", rules AS (SELECT seq, 'rule_based' AS alert_type, city, category, alert_level AS level, timestamp,
    aqi AS current_aqi, city || ': AQI ' || printf('%.1f', aqi) || ' (' || category || ')' AS message, recommendation,
    threshold_min, threshold_max FROM (SELECT *, {CATEGORY.format(v='aqi')} AS category FROM readings)
    JOIN {CATEGORY_TABLE} USING (category) WHERE alert_level <> 'none')"""
RESULTS = ", results AS (SELECT seq, city, timestamp, aqi AS current_aqi, aqi * 0.9 + 5 AS predicted_aqi FROM readings WHERE aqi IS NOT NULL)"
MODELS = f""", models AS (SELECT seq, 'model_based' AS alert_type, city, {by_prediction('predicted_aqi', 1)} AS level, timestamp,
    current_aqi, predicted_aqi, CAST(150 AS DOUBLE) AS threshold, {by_prediction('predicted_aqi', 2)} AS recommendation
    FROM results WHERE predicted_aqi > 150)"""


def sent(source: str) -> str:
    """The first alert of each key, then again and again the first one an hour after the last."""
    return f""", instants AS (SELECT city, level, timestamp, min(seq) AS seq FROM {source} GROUP BY ALL
    ), chain AS (
        SELECT city, level, min(timestamp) AS timestamp FROM instants GROUP BY ALL
        UNION ALL
        SELECT c.city, c.level, (SELECT min(i.timestamp) FROM instants i WHERE i.city = c.city AND i.level = c.level
            AND i.timestamp >= c.timestamp + INTERVAL 1 HOUR) FROM chain c WHERE c.timestamp IS NOT NULL
    ), sent AS (SELECT a.* FROM {source} a JOIN instants USING (city, level, timestamp, seq)
        JOIN (SELECT * FROM chain WHERE timestamp IS NOT NULL) USING (city, level, timestamp))"""


ORACLE["rule_alerts"] = readings(
    f"{RULES} SELECT seq, {alert_id('rule_based')} AS alert_id, alert_type, city, category, level, {US}, current_aqi, message, "
    "recommendation, threshold_min, threshold_max FROM rules"
)
ORACLE["model_alerts"] = readings(
    f"""{RESULTS}{MODELS} SELECT seq, {alert_id('model_based')} AS alert_id, alert_type, city, level, {r6('current_aqi', 'current_aqi')},
    {r6('predicted_aqi', 'predicted_aqi')}, threshold, recommendation,
    city || ': Predicted AQI ' || printf('%.1f', predicted_aqi) || ' exceeds threshold (150)' AS message FROM models"""
)
ORACLE["alert_preview"] = readings(
    f"""{RESULTS} SELECT seq, {r6('predicted_aqi', 'predicted_aqi')}, CAST(150 AS DOUBLE) AS threshold,
    predicted_aqi > 150 AS will_trigger_alert, {by_prediction('predicted_aqi', 1)} AS alert_level,
    {by_prediction('predicted_aqi', 2)} AS recommendation FROM results"""
)
ORACLE["suppress_repeats"] = readings(f"{RULES}{sent('rules')} SELECT seq, city, level, {US} FROM sent", True)
ORACLE["stream_suppress_repeats"] = ORACLE["suppress_repeats"]
NOW = "(SELECT max(timestamp) FROM readings)"
STATE = f""", state AS (SELECT city, level, max(timestamp) AS last_sent,
    (epoch_us({NOW}) - epoch_us(max(timestamp))) / 1e6 AS since FROM sent GROUP BY ALL)"""
ORACLE["suppression_state"] = readings(
    f"""{RULES}{sent('rules')}{STATE} SELECT city, level, epoch_us(last_sent) AS last_sent_us,
    {r6('greatest(0.0, 3600 - since)', 'seconds_until_next')}, since > 3600 AS expired FROM state""",
    True,
)
ORACLE["stream_suppression_state"] = readings(
    f"""{RULES}{sent('rules')} SELECT city, level, epoch_us(max(timestamp)) AS last_sent_us FROM sent GROUP BY city, level
    HAVING max(timestamp) + INTERVAL 2 HOUR > (SELECT max(timestamp) FROM rules)""",
    True,
)
ORACLE["suppression_totals"] = readings(
    f"""{RULES}{sent('rules')}{STATE} SELECT CAST(1 AS INTEGER) AS dedup_window_hours, count(*) AS total_entries,
    count(DISTINCT city) AS unique_cities, count(DISTINCT level) AS unique_levels FROM state""",
    True,
)
FLOW = f"""{RULES}{RESULTS}{MODELS}, flow AS (
    SELECT seq * 2 AS seq, alert_type, city, level, category, timestamp, current_aqi, CAST(NULL AS DOUBLE) AS predicted_aqi,
        CAST(NULL AS DOUBLE) AS threshold FROM rules
    UNION ALL SELECT seq * 2 + 1, alert_type, city, level, NULL, timestamp, current_aqi, predicted_aqi, threshold FROM models){sent('flow')}"""
ORACLE["alert_flow"] = readings(
    f"""{FLOW} SELECT seq, alert_type, city, level, {US}, {r6('current_aqi', 'current_aqi')},
    {r6('predicted_aqi', 'predicted_aqi')} FROM sent""",
    True,
)
ORACLE["alert_store_round_trip"] = readings(
    f"""{FLOW} SELECT sha256(concat_ws('|', alert_type, city, level, epoch_us(timestamp))) AS alert_id, alert_type, city, level,
    category, {US}, {r6('current_aqi', 'current_aqi')}, {r6('predicted_aqi', 'predicted_aqi')}, threshold,
    strftime(timestamp, '%Y-%m-%d') AS date FROM sent""",
    True,
)
STORE = f"{RULES}{sent('rules')}, stored AS (SELECT *, {alert_id('rule_based')} AS alert_id, seq % 3 = 0 AS acknowledged FROM sent)"
RECENT = f"timestamp > {NOW} - INTERVAL 168 HOURS"
ORACLE["active_alerts"] = readings(f"{STORE} SELECT alert_id, city, level, {US} FROM stored WHERE NOT acknowledged", True)
ORACLE["get_alert"] = readings(f"{STORE} SELECT alert_id, city, level, {US} FROM stored ORDER BY alert_id DESC LIMIT 1", True)
ORACLE["active_alerts_filtered"] = readings(
    f"{STORE} SELECT alert_id, city, level, {US} FROM stored WHERE NOT acknowledged AND city = 'error' AND level = 'warning'",
    True,
)
ORACLE["alerts_by_city"] = readings(
    f"""{STORE} SELECT alert_id, level, {US}, acknowledged, CASE WHEN acknowledged THEN 'operator' END AS acknowledged_by
    FROM stored WHERE city = 'error' AND {RECENT}""",
    True,
)
ORACLE["alerts_by_city_acknowledged"] = readings(
    f"""{STORE} SELECT alert_id, level, {US}, epoch_us(timestamp) AS acknowledged_at_us
    FROM stored WHERE city = 'view' AND {RECENT} AND acknowledged""",
    True,
)
ORACLE["alerts_by_level"] = readings(
    f"{STORE} SELECT alert_id, city, {US} FROM stored WHERE level = 'warning' AND {RECENT}", True
)
ORACLE["acknowledge"] = readings(
    f"""{STORE} SELECT alert_id, 'operator' AS acknowledged_by, epoch_us({NOW}) AS acknowledged_at_us
    FROM stored WHERE acknowledged""",
    True,
)
ORACLE["alert_stats"] = readings(
    f"""{STORE}, recent AS (SELECT * FROM stored WHERE {RECENT}),
    t AS (SELECT 'all' AS grouping, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS level, acknowledged FROM recent
    UNION ALL SELECT 'level', NULL, level, acknowledged FROM recent UNION ALL SELECT 'city', city, NULL, acknowledged FROM recent)
    SELECT grouping, city, level, count(*) AS total_alerts, count(*) FILTER (NOT acknowledged) AS active_alerts FROM t GROUP BY ALL""",
    True,
)

# ------------------------------------------------------------------ serving

ORACLE["latest_by_city"] = readings(
    f"SELECT seq, city, {US}, aqi, pm25 FROM readings QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC, seq DESC) = 1"
)
ORACLE["history"] = readings(
    f"SELECT city, {US}, aqi FROM readings WHERE city IN ('error', 'view') AND timestamp > {NOW} - INTERVAL 7 DAYS"
)
ORACLE["city_list"] = readings("SELECT DISTINCT city FROM readings")

# ------------------------------------------------------------------ models: what is certain about them

ORACLE["predicted_rows"] = readings(
    f"""{silver('timestamp')}, n AS (SELECT city, row_number() OVER (ORDER BY timestamp, seq) - 1 AS i, count(*) OVER () AS total
    FROM silver) SELECT kind, city, count(*) AS records, count(*) AS predicted
    FROM n, (VALUES ('boosted_trees'), ('random_forest')) k(kind)
    WHERE i >= CAST(floor(total * (1 - 0.2)) AS BIGINT) GROUP BY kind, city"""
)
ORACLE["fold_sizes"] = readings(
    f"""{silver('timestamp')}, t AS (SELECT count(*) // 4 AS size FROM silver)
    SELECT CAST(fold AS INTEGER) AS fold, role, CASE WHEN role = 'train' THEN size * fold ELSE size END AS records
    FROM t, (VALUES (1), (2), (3)) f(fold), (VALUES ('train'), ('test')) r(role)"""
)
ORACLE["importance_total"] = f"SELECT {len(MODEL_FEATURES)} AS features, 1.0 AS total, true AS none_negative"
ORACLE["profile_from_summaries"] = readings(
    f""", span AS (SELECT * FROM readings WHERE CAST(timestamp AS DATE) <= (SELECT min(CAST(timestamp AS DATE)) + 9 FROM readings)),
    long AS (SELECT 'aqi' AS feature, aqi AS v FROM span UNION ALL SELECT 'pm25', pm25 FROM span)
    SELECT feature, count(*) AS records, count(*) - count(v) AS missing, {r6('(count(*) - count(v)) * 100.0 / count(*)', 'missing_pct')},
    {r6('min(v)', 'min')}, {r6('max(v)', 'max')}, {r6('avg(v)', 'mean')}, {r6('stddev_samp(v)', 'std')},
    true AS distinct_near, true AS quartiles_near FROM long GROUP BY feature"""
)
# Trees of one split. Fit 0 learns from the first 80 percent and is tested on the rest, fits 1 to 3 are the folds along time,
# fit 4 learns from all rows. The best split leaves the least squared error, so the greatest sum of n * mean^2 of both sides.
ONE_SPLIT = f"""{silver('timestamp')}, n AS (SELECT *, {calendar('timestamp')},
        row_number() OVER (ORDER BY timestamp, seq) - 1 AS i, count(*) OVER () AS total FROM silver),
    fits AS (
        SELECT 0 AS fit, CASE WHEN i < CAST(floor(total * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'test' END AS role, * FROM n
        UNION ALL SELECT fold, CASE WHEN i < (total // 4) * fold THEN 'train' ELSE 'test' END, n.*
        FROM n, (VALUES (1), (2), (3)) f(fold) WHERE i < (total // 4) * (fold + 1)),
    long AS (
        SELECT fit, 'hour_of_day' AS feature, hour_of_day AS value, aqi FROM fits WHERE role = 'train'
        UNION ALL SELECT fit, 'day_of_week', day_of_week, aqi FROM fits WHERE role = 'train'),
    counted AS (SELECT fit, feature, value, count(*) AS n, sum(aqi) AS s FROM long GROUP BY ALL),
    sides AS (SELECT *, sum(n) OVER up AS n1, sum(s) OVER up AS s1, sum(n) OVER (PARTITION BY fit, feature) AS n0,
        sum(s) OVER (PARTITION BY fit, feature) AS s0, lead(value) OVER up AS following
        FROM counted WINDOW up AS (PARTITION BY fit, feature ORDER BY value)),
    split AS (SELECT fit, feature, (value + following) / 2.0 AS cut, s1 / n1 AS low, (s0 - s1) / (n0 - n1) AS high FROM sides
        WHERE following IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY fit ORDER BY s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) DESC) = 1),
    predicted AS (SELECT f.*, CASE WHEN CASE feature WHEN 'hour_of_day' THEN hour_of_day ELSE day_of_week END <= cut
        THEN low ELSE high END AS prediction FROM fits f JOIN split USING (fit) WHERE role = 'test'),
    scores AS (SELECT fit, count(*) AS n, sqrt(avg((aqi - prediction) ** 2)) AS rmse, avg(abs(aqi - prediction)) AS mae,
        1 - avg((aqi - prediction) ** 2) / var_pop(aqi) AS r2,
        avg(CASE WHEN aqi <> 0 THEN abs(aqi - prediction) / abs(aqi) * 100 END) AS mape,
        stddev_pop(aqi - prediction) AS sigma FROM predicted GROUP BY fit)"""
KINDS = "(VALUES ('boosted_trees'), ('random_forest')) k(model)"
SCORES = ", ".join(r6(c, c) for c in ("rmse", "mae", "r2", "mape"))
ORACLE["one_split_predictions"] = readings(
    f"{ONE_SPLIT} SELECT model, seq, {r6('prediction', 'prediction')} FROM predicted, {KINDS} WHERE fit = 0"
)
ORACLE["one_split_importance"] = readings(
    f"""{ONE_SPLIT} SELECT model, f.feature, CASE WHEN f.feature = s.feature THEN 1.0 ELSE 0.0 END AS importance
    FROM split s, {KINDS}, (VALUES ('hour_of_day'), ('day_of_week')) f(feature) WHERE fit = 0"""
)
ORACLE["one_split_metrics"] = readings(f"{ONE_SPLIT} SELECT model, n, {SCORES} FROM scores, {KINDS} WHERE fit = 0")
ORACLE["one_split_folds"] = readings(f"{ONE_SPLIT} SELECT CAST(fit AS INTEGER) AS fold, n, {SCORES} FROM scores WHERE fit > 0")
ORACLE["train_all"] = readings(
    f"""{ONE_SPLIT}, means AS (SELECT true AS use_cv, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2 FROM scores WHERE fit > 0
        UNION ALL SELECT false, NULL, NULL, NULL)
    SELECT model, (SELECT count(*) FROM silver) AS rows, CAST(2 AS INTEGER) AS n_features, use_cv, {r6('rmse', 'rmse_mean')},
    {r6('mae', 'mae_mean')}, {r6('r2', 'r2_mean')} FROM means, {KINDS}"""
)
ORACLE["training_summary"] = """SELECT * FROM (VALUES ('boosted_trees', 2, true, CAST(NULL AS DOUBLE)),
    ('random_forest', 1, true, NULL)) v(model, runs, dated, best_rmse)"""
ORACLE["one_split_forecast"] = readings(
    f"""{ONE_SPLIT}, ahead AS (SELECT city, max(timestamp) + INTERVAL 1 HOUR * step AS timestamp
        FROM silver, range(1, 25) r(step) GROUP BY city, step),
    stamped AS (SELECT city, {US}, {calendar('timestamp')} FROM ahead),
    valued AS (SELECT city, timestamp_us, CASE WHEN CASE feature WHEN 'hour_of_day' THEN hour_of_day ELSE day_of_week END <= cut
        THEN low ELSE high END AS v FROM stamped, split WHERE fit = 0)
    SELECT city, timestamp_us, {r6('v', 'predicted_aqi')}, {r6('v + 1.96 * sigma', 'upper_bound')}, {r6('v - 1.96 * sigma', 'lower_bound')}
    FROM valued, scores WHERE fit = 0"""
)
ORACLE["stream_score_one_split"] = readings(
    f"""{ONE_SPLIT}, stamped AS (SELECT seq, city, {US}, aqi, {calendar('timestamp')} FROM readings WHERE aqi IS NOT NULL)
    SELECT seq, city, timestamp_us, {r6('aqi', 'current_aqi')}, {r6("""CASE WHEN CASE feature WHEN 'hour_of_day' THEN hour_of_day
        ELSE day_of_week END <= cut THEN low ELSE high END""", 'predicted_aqi')}, true AS features_computed, CAST(NULL AS VARCHAR) AS error
    FROM stamped, split WHERE fit = 0"""
)
ORACLE["forecast_shape"] = readings(
    f"{silver('timestamp')} SELECT DISTINCT city, 24 AS hours, 24 AS stamps, 24 AS inside, true AS one_width FROM silver"
)
ORACLE["registry_counts"] = """SELECT * FROM (VALUES ('all', NULL, 2), ('type', 'boosted_trees', 1), ('type', 'random_forest', 1),
    ('name', 'boosted_trees', 1), ('name', 'random_forest', 1)) v("grouping", "value", models)"""
ORACLE["scaler_round_trip"] = "SELECT " + ", ".join(f"0.0 AS {c}_mean" for c in MEASURES) + ", count(*) AS records FROM lineitem"
ORACLE["fingerprint_of_shuffled"] = "SELECT count(*) AS records, 1 AS fingerprints FROM events"
ORACLE["stream_dedup"] = readings(
    "SELECT DISTINCT city, epoch_us(date_trunc('minute', timestamp)) AS timestamp_us FROM readings WHERE aqi IS NOT NULL"
)
