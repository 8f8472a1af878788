"""Table schemas, and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# These values have to be exactly these for results to be right.

POLLUTANTS = ["pm25", "pm10", "no2", "o3", "so2", "co"]
CRITICAL_FIELDS = ["city", "timestamp", "aqi"]
AQI_MIN = 0.0
AQI_MAX = 500.0

# category, lowest, highest, alert level, colour, advice
CATEGORIES = [
    ("Good", 0, 50, "none", "#00E400",
     "Air quality is satisfactory. Enjoy outdoor activities."),
    ("Satisfactory", 51, 100, "info", "#FFFF00",
     "Air quality is acceptable. Sensitive groups should limit prolonged outdoor activities."),
    ("Moderately Polluted", 101, 200, "warning", "#FF7E00",
     "Members of sensitive groups should reduce prolonged outdoor activities."),
    ("Heavily Polluted", 201, 300, "severe", "#FF0000",
     "Everyone should reduce prolonged outdoor activities. Sensitive groups should avoid outdoor activities."),
    ("Severely Polluted", 301, 500, "critical", "#8F0000",
     "Avoid outdoor activities. Everyone should wear N95 masks if going outside."),
]

# highest predicted value of the level (None: no bound), level, advice
PREDICTION_LEVELS = [
    (100, "info", "Monitor air quality. Sensitive groups should limit outdoor activities."),
    (200, "warning", "Sensitive groups should reduce prolonged outdoor activities."),
    (300, "severe",
     "Everyone should reduce prolonged outdoor activities. Sensitive groups should avoid outdoor activities."),
    (None, "critical", "Avoid outdoor activities. Everyone should wear N95 masks if going outside."),
]

# city, latitude, longitude
CITIES = [
    ("Delhi", 28.7041, 77.1025),
    ("Mumbai", 19.0760, 72.8777),
    ("Bangalore", 12.9716, 77.5946),
    ("Kolkata", 22.5726, 88.3639),
    ("Chennai", 13.0827, 80.2707),
    ("Hyderabad", 17.3850, 78.4867),
    ("Pune", 18.5204, 73.8567),
    ("Ahmedabad", 23.0225, 72.5714),
    ("Jaipur", 26.9124, 75.7873),
    ("Lucknow", 26.8467, 80.9462),
]

SEASONS = {
    "Winter": [12, 1, 2],
    "Summer": [3, 4, 5],
    "Monsoon": [6, 7, 8, 9],
    "Post-Monsoon": [10, 11],
}

LAG_OFFSETS = [1, 3, 6, 12, 24]
ROLLING_WINDOWS = [3, 6, 12, 24]
STREAMING_WINDOW_HOURS = 24
MAX_LATENCY_MS = 1000
ALERT_WINDOW_HOURS = 1
PREDICTION_THRESHOLD = 150
CV_FOLDS = 3
RUN_TARGET_SECONDS = 300
# ------------------------------------------------------------ end fixed values

LAG_FEATURES = [f"aqi_lag_{n}h" for n in LAG_OFFSETS]
ROLLING_FEATURES = [f"aqi_{stat}_{n}h" for n in ROLLING_WINDOWS for stat in ("mean", "std", "min", "max")]
CALENDAR_FEATURES = ["hour_of_day", "day_of_week", "month", "is_weekend"]
FEATURES = LAG_FEATURES + ROLLING_FEATURES + CALENDAR_FEATURES + ["season"]

_measures = [T.StructField(name, T.DoubleType()) for name in ["aqi", *POLLUTANTS]]

READING = T.StructType(
    [T.StructField("city", T.StringType()), T.StructField("timestamp", T.TimestampType()), *_measures]
)
BRONZE = T.StructType(
    READING.fields
    + [
        T.StructField("source", T.StringType()),
        T.StructField("ingestion_timestamp", T.TimestampType()),
        T.StructField("retrieval_time", T.DoubleType()),
    ]
)
SILVER = T.StructType(
    READING.fields
    + [
        T.StructField("source", T.StringType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("aqi", T.DoubleType()),
        T.StructField("pollutants", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
FEED_PAYLOAD = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("aqi", T.StringType()),
                    T.StructField("time", T.StructType([T.StructField("iso", T.StringType())])),
                    T.StructField(
                        "iaqi",
                        T.StructType(
                            [
                                T.StructField(name, T.StructType([T.StructField("v", T.DoubleType())]))
                                for name in POLLUTANTS
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("current_aqi", T.DoubleType()),
        T.StructField("predicted_aqi", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("message", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
ACKNOWLEDGEMENT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("acknowledged_at", T.TimestampType()),
        T.StructField("acknowledged_by", T.StringType()),
    ]
)


def category_table(spark: SparkSession) -> DataFrame:
    """The five category rows."""
    return spark.createDataFrame(
        CATEGORIES,
        "category string, threshold_min int, threshold_max int, alert_level string, color string, "
        "recommendation string",
    )


def city_table(spark: SparkSession) -> DataFrame:
    """The ten monitored cities."""
    return spark.createDataFrame(CITIES, "city string, latitude double, longitude double")
