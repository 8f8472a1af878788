"""Registered models: MLlib folders next to an append-only metadata table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.operators.evaluate import best_model
from zephyra.operators.models import Trained
from zephyra.plans.trees import Ensemble
from zephyra.sources.tables import read_or_empty

LOADERS = {"boosted_trees": GBTRegressionModel, "random_forest": RandomForestRegressionModel}

METADATA = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("target", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("recorded_at", T.TimestampType()),
    ]
)


class ModelRegistry:
    """``<folder>/metadata`` and ``<folder>/models/<id>``. The newest record of an id counts; a deletion is a record."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _append(self, row: tuple) -> None:
        record = self.spark.createDataFrame([(*row, None)], METADATA)
        record = record.withColumn("recorded_at", F.current_timestamp())
        record.coalesce(1).write.mode("append").parquet(f"{self.folder}/metadata")

    def register(self, trained: Trained, name: str, version: str, metrics: dict[str, float]) -> str:
        """Save the model and its record; returns the id, ``name_version``."""
        model_id = f"{name}_{version}"
        path = f"{self.folder}/models/{model_id}"
        trained.model.write().overwrite().save(path)
        parameters = {k: str(v) for k, v in trained.parameters.items()}
        values = {k: float(v) for k, v in metrics.items()}
        self._append(
            (model_id, name, trained.kind, version, values, parameters, trained.columns, trained.target, path, False)
        )
        return model_id

    def models(self, name: str | None = None) -> DataFrame:
        """The records in force."""
        records = read_or_empty(self.spark, f"{self.folder}/metadata", METADATA)
        newest = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("recorded_at")))
        current = records.withColumn("_n", newest).where("_n = 1 and not deleted").drop("_n", "deleted")
        return current if name is None else current.where(F.col("model_name") == name)

    def info(self, model_id: str):
        """The record of one model."""
        row = self.models().where(F.col("model_id") == model_id).first()
        if row is None:
            raise ValueError(f"no such model: {model_id}")
        return row

    def get(self, model_id: str) -> Trained:
        """The model, ready to use."""
        row = self.info(model_id)
        model = self._load(row["model_type"], row["path"])
        return Trained(
            row["model_type"], model, row["feature_columns"], row["target"], row["hyperparameters"], 0, row["metrics"]
        )

    def _load(self, kind: str, path: str):
        try:
            return Ensemble.load(self.spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return LOADERS[kind].load(path)  # fitted by MLlib

    def delete(self, model_id: str) -> None:
        """Withdraw a model. Its folder stays for those who still read it."""
        row = self.info(model_id)
        self._append((*[row[f] for f in METADATA.fieldNames()[:9]], True))

    def best(self, metric: str = "r2", name: str | None = None):
        """The record with the best value of ``r2``, ``rmse`` or ``mae``."""
        rows = self.models(name).select(
            "*", F.col("model_id").alias("model"), *[F.col("metrics")[m].alias(m) for m in ("r2", "rmse", "mae")]
        )
        row = best_model(rows, metric).first()
        if row is None:
            raise ValueError("no model with that metric")
        return row

    def stats(self) -> DataFrame:
        """``grouping, value, models``: how many in all, by type and by name."""
        sets = self.models().groupingSets([[], ["model_type"], ["model_name"]], "model_type", "model_name").agg(
            F.grouping_id("model_type", "model_name").alias("_g"), F.count("*").alias("models")
        )
        kind = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "type").otherwise("name")
        return sets.select(kind.alias("grouping"), F.coalesce("model_type", "model_name").alias("value"), "models")
