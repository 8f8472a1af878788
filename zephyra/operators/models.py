"""Training, cross-validation, prediction and forecasting with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.functions.calendar import calendar_parts
from zephyra.functions.columns import need_columns
from zephyra.operators.evaluate import best_model, regression_metrics
from zephyra.operators.splits import expanding_folds
from zephyra.plans import trees
from zephyra.plans.tables import write_out
from zephyra.sources.tables import read_or_empty
from zephyra.schemas import CALENDAR_FEATURES, CV_FOLDS, LAG_FEATURES, LAG_OFFSETS, ROLLING_FEATURES, ROLLING_WINDOWS

#: Training data to a task, and the most tasks of a pass. Every task sends the sums of all nodes that a pass looks at, so the
#: shuffle grows with the tasks and not with the rows; both are fixed, as bagging is seeded per partition.
ROWS_PER_TASK, MOST_TASKS = 50_000, 12
#: The most rows that MLlib fits. Its forests send the sums of every open node, its boosting has no more tasks beyond.
MLLIB_ROWS = {"boosted_trees": ROWS_PER_TASK * MOST_TASKS, "random_forest": ROWS_PER_TASK}
MODEL_FEATURES = LAG_FEATURES + ROLLING_FEATURES + CALENDAR_FEATURES

# fixed values: default training parameters
BOOSTED_TREES = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100, "seed": 42}
RANDOM_FOREST = {
    "numTrees": 100,
    "maxDepth": 15,
    "minInstancesPerNode": 3,
    "featureSubsetStrategy": "all",
    "seed": 42,
}
#: Fits that run at once. Each one is many short jobs that leave cores idle at their ends.
FITS_AT_ONCE = 3
KINDS = {"boosted_trees": (GBTRegressor, BOOSTED_TREES), "random_forest": (RandomForestRegressor, RANDOM_FOREST)}


@dataclass
class Trained:
    """A fitted model with what is needed to use and compare it."""

    kind: str
    model: object
    columns: list[str]
    target: str
    parameters: dict
    rows: int
    cv: dict[str, float] = field(default_factory=dict)


def assembled(df: DataFrame, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """Add the vector ``features``; a missing column or value is ``fill``."""
    present = set(df.columns)
    names = [f"_f{i}" for i in range(len(columns))]

    def value(c: str):
        if c not in present:
            return F.lit(fill)
        known = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return known if fill is None else F.coalesce(known, F.lit(fill))

    made = df.withColumns({n: value(c) for n, c in zip(names, columns)})
    return VectorAssembler(inputCols=names, outputCol="features").transform(made).drop(*names)


def estimator(kind: str, parameters: dict | None = None):
    """The MLlib estimator of a kind, the defaults overridden by ``parameters``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}")
    cls, defaults = KINDS[kind]
    return cls(featuresCol="features", labelCol="label", **{**defaults, **(parameters or {})})


def fitted(kind: str, rows: DataFrame, parameters: dict | None = None):
    """The model over ``features`` and ``label``: MLlib's up to ``MLLIB_ROWS``, else one of ``plans/trees.py``."""
    chosen = {**KINDS[kind][1], **(parameters or {})}
    if trees.can_fit(kind, chosen) and (total := rows.count()) > MLLIB_ROWS[kind]:
        return trees.fit(kind, rows, chosen, total)
    return estimator(kind, parameters).fit(rows)


def side_by_side(spark: SparkSession, works: list[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """The results of ``works`` in their order, at most ``at_once`` of them running at a time.

    Each has a scheduler pool of its own, so with ``spark.scheduler.mode=FAIR`` they share the cores evenly. The first
    failure is raised when all have ended.
    """

    def run(place: int, work: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{place}")
        try:
            return work()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if at_once <= 1 or len(works) <= 1:
        return [work() for work in works]
    with ThreadPool(min(at_once, len(works))) as pool:
        made = [pool.apply_async(inheritable_thread_target(spark)(run), (i, work)) for i, work in enumerate(works)]
        for one in made:
            one.wait()
        return [one.get() for one in made]


@contextmanager
def _prepared(df: DataFrame, columns: list[str], target: str, *keep: str) -> Iterator[DataFrame]:
    """Vector and label of the rows that have one.

    A fit passes over its table hundreds of times, so the table is written out once (its windows do not run again, also
    not when an executor is lost), and kept in a bounded number of partitions: every pass is a job, a task of it sends sums
    of one size however few rows it has, and the driver hears from each task of each pass.
    """
    need_columns(df, target, *columns)
    labelled = assembled(df.where(F.col(target).isNotNull()), columns)
    written = write_out(labelled.select(*keep, "features", F.col(target).cast("double").alias("label")))
    rows = written.count()
    partitions = min(MOST_TASKS, max(1, -(-rows // ROWS_PER_TASK)))
    by = [c for c in keep if c in written.columns] or ["features", "label"]
    ready = written.repartition(partitions, F.xxhash64(*by)).sortWithinPartitions(*by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield ready
    finally:
        ready.unpersist()


def train(
    kind: str,
    df: DataFrame,
    columns: list[str] = MODEL_FEATURES,
    target: str = "aqi",
    parameters: dict | None = None,
    cv_folds: int | None = None,
    ts: str = "timestamp",
    tie: str = "seq",
    at_once: int = FITS_AT_ONCE,
) -> Trained:
    """Fit one model; with ``cv_folds``, also score it on that many folds along time, ``at_once`` fits at a time."""
    estimator(kind, parameters)  # raises for an unknown kind
    chosen = {**KINDS[kind][1], **(parameters or {})}
    with _prepared(df, columns, target, ts, tie) as ready:
        rows = ready.count()
        if rows == 0:
            raise ValueError("nothing to train on")
        works = [lambda: fitted(kind, ready, parameters)]
        works += _folds(kind, parameters, ready, cv_folds, ts, tie) if cv_folds else []
        model, *scores = side_by_side(df.sparkSession, works, at_once)
        return Trained(kind, model, list(columns), target, chosen, rows, _fold_means(scores))


def train_boosted_trees(df: DataFrame, **options) -> Trained:
    return train("boosted_trees", df, **options)


def train_random_forest(df: DataFrame, **options) -> Trained:
    return train("random_forest", df, **options)


def train_all(df: DataFrame, parameters: dict[str, dict] | None = None, cv_folds: int | None = CV_FOLDS, **options):
    """Both kinds of model by name."""
    parameters = parameters or {}
    return {kind: train(kind, df, parameters=parameters.get(kind), cv_folds=cv_folds, **options) for kind in KINDS}


def _folds(kind: str, parameters: dict | None, ready: DataFrame, n: int, ts: str, tie: str) -> list[Callable]:
    """For each fold the work that fits on its past, scores what follows, and gives one row of metrics."""
    split = expanding_folds(ready, n, ts, tie)

    def work(fold: int) -> Callable:
        def run() -> dict:
            part = split.where(F.col("fold") == fold)
            model = fitted(kind, part.where("role = 'train'"), parameters)
            scored = model.transform(part.where("role = 'test'"))
            return {"fold": fold, **regression_metrics(scored, "label", "prediction").first().asDict()}

        return run

    return [work(fold) for fold in range(1, n + 1)]


def _fold_means(scores: list[dict]) -> dict[str, float]:
    """Means over the folds that have the metric."""
    known = {m: [s[m] for s in scores if s[m] is not None] for m in ("rmse", "mae", "r2")}
    return {f"{m}_mean": sum(v) / len(v) if v else None for m, v in known.items()} if scores else {}


def cross_validate(
    kind: str,
    df: DataFrame,
    n_folds: int = CV_FOLDS,
    columns: list[str] = MODEL_FEATURES,
    target: str = "aqi",
    parameters: dict | None = None,
    ts: str = "timestamp",
    tie: str = "seq",
    at_once: int = FITS_AT_ONCE,
) -> DataFrame:
    """``fold, n, rmse, mae, r2, mape`` of every fold. The fits run here, ``at_once`` at a time; the scores are small."""
    estimator(kind, parameters)  # raises for an unknown kind
    with _prepared(df, columns, target, ts, tie) as ready:
        scores = side_by_side(df.sparkSession, _folds(kind, parameters, ready, n_folds, ts, tie), at_once)
    names = ["fold", "n", "rmse", "mae", "r2", "mape"]
    return df.sparkSession.createDataFrame(
        [tuple(s[c] for c in names) for s in scores], "fold int, n long, rmse double, mae double, r2 double, mape double"
    )


def predict(trained: Trained, df: DataFrame) -> DataFrame:
    """Add ``prediction``."""
    return trained.model.transform(assembled(df, trained.columns)).drop("features")


RUNS = T.StructType(
    [
        T.StructField("trained_at", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("use_cv", T.BooleanType()),
        T.StructField("rmse_mean", T.DoubleType()),
        T.StructField("mae_mean", T.DoubleType()),
        T.StructField("r2_mean", T.DoubleType()),
    ]
)


def training_runs(spark, trained: dict[str, Trained]) -> DataFrame:
    """``trained_at, model, rows, n_features, use_cv, rmse_mean, mae_mean, r2_mean``, to append to a history table."""
    rows = [
        (None, name, t.rows, len(t.columns), bool(t.cv), t.cv.get("rmse_mean"), t.cv.get("mae_mean"), t.cv.get("r2_mean"))
        for name, t in trained.items()
    ]
    return spark.createDataFrame(rows, RUNS).withColumn("trained_at", F.current_timestamp())


def record_runs(spark, trained: dict[str, Trained], path: str) -> None:
    """Append a training to the history table in ``path``."""
    training_runs(spark, trained).coalesce(1).write.mode("append").parquet(path)


def training_history(spark, path: str) -> DataFrame:
    """All trainings that were recorded; none of a folder that is not there."""
    return read_or_empty(spark, path, RUNS)


def training_summary(history: DataFrame) -> DataFrame:
    """``model, runs, last_trained, best_rmse`` of each model in a :func:`training_history`."""
    return history.groupBy("model").agg(
        F.count("*").alias("runs"), F.max("trained_at").alias("last_trained"), F.min("rmse_mean").alias("best_rmse")
    )


def best_trained(spark, trained: dict[str, Trained], metric: str = "r2") -> str:
    """Name of the best model by its cross-validation mean."""
    means = training_runs(spark, trained).select("model", *[F.col(f"{m}_mean").alias(m) for m in ("r2", "rmse", "mae")])
    best = best_model(means, metric).first()
    if best is None:
        raise ValueError("no model was cross-validated")
    return best["model"]


def evaluate_all(trained: dict[str, Trained], test: DataFrame) -> DataFrame:
    """``model, n, rmse, mae, r2, mape`` of every model on one test table."""
    together = None
    for name, t in trained.items():
        scored = predict(t, test.where(F.col(t.target).isNotNull()))
        part = regression_metrics(scored, t.target, "prediction").select(F.lit(name).alias("model"), "*")
        together = part if together is None else together.unionByName(part)
    if together is None:
        raise ValueError("no models")
    return together


def model_feature_importance(trained: Trained, spark, top_n: int | None = None) -> DataFrame:
    """``feature, importance``, highest first."""
    values = trained.model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(trained.columns, values)]
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked if top_n is None else ranked.limit(top_n)


def residual_sigma(trained: Trained, df: DataFrame) -> float:
    """Population deviation of the residuals on a table with known targets."""
    scored = predict(trained, df.where(F.col(trained.target).isNotNull()))
    return scored.agg(F.stddev_pop(F.col(trained.target) - F.col("prediction"))).first()[0]


def forecast_24h(
    trained: Trained,
    history: DataFrame,
    sigma: float,
    steps: int = 24,
    z: float = 1.96,
    keys: list[str] = ("city",),
    ts: str = "timestamp",
    tie: str = "seq",
) -> DataFrame:
    """``city, timestamp, predicted_aqi, upper_bound, lower_bound`` for the next ``steps`` hours of every key.

    The model must be trained on ``prior_features``. The last 24 values of a key are one array; each step derives the
    features from it, predicts, and appends. All keys step together. The table is written out every few steps, so that
    the plan stays short.
    """
    keys = list(keys)
    column, depth = trained.target, max([*LAG_OFFSETS, *ROLLING_WINDOWS])
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc()))
    known = history.where(F.col(column).isNotNull() & F.col(ts).isNotNull())
    recent = known.select(*keys, ts, tie, column).withColumn("_n", newest).where(F.col("_n") <= depth)
    state = recent.groupBy(*keys).agg(  # at most `depth` rows of each key are left
        F.max(ts).alias("_at"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(column).cast("double").alias("v")))),
            lambda x: x["v"],
        ).alias("_values"),
        F.array().cast("array<struct<at:timestamp,value:double>>").alias("_made"),
    )
    size = F.size("_values")
    hour = F.expr("INTERVAL 1 HOUR")
    for step in range(1, steps + 1):
        made = {f"{column}_lag_{n}h": F.when(size >= n, F.element_at("_values", -n)) for n in LAG_OFFSETS}
        for n in ROLLING_WINDOWS:
            part = F.slice("_values", F.greatest(size - n + 1, F.lit(1)), n)
            count = F.size(part).cast("double")
            mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / count
            squares = F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x)
            spread = F.greatest(squares - count * mean * mean, F.lit(0.0))
            made[f"{column}_mean_{n}h"] = mean
            made[f"{column}_std_{n}h"] = F.when(count > 1, F.sqrt(spread / (count - 1)))
            made[f"{column}_min_{n}h"] = F.array_min(part)
            made[f"{column}_max_{n}h"] = F.array_max(part)
        rows = state.withColumn("_at", (F.col("_at") + hour).cast("timestamp")).withColumns(made)
        rows = rows.select("*", *calendar_parts("_at"))
        rows = trained.model.transform(assembled(rows, trained.columns))
        values = F.concat(F.col("_values"), F.array("prediction"))
        entry = F.array(F.struct(F.col("_at").alias("at"), F.col("prediction").alias("value")))
        state = rows.select(
            *keys,
            "_at",
            F.slice(values, F.greatest(F.size(values) - depth + 1, F.lit(1)), depth).alias("_values"),
            F.concat("_made", entry).alias("_made"),
        )
        if step % 4 == 0 and step < steps:
            state = write_out(state)
    return state.select(*keys, F.inline("_made")).select(
        *keys,
        F.col("at").alias(ts),
        F.col("value").alias(f"predicted_{column}"),
        (F.col("value") + z * sigma).alias("upper_bound"),
        (F.col("value") - z * sigma).alias("lower_bound"),
    )
