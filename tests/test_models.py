from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from zephyra.operators import features, models
from zephyra.operators.registry import ModelRegistry
from zephyra.streaming.scoring import score

FAST = {"boosted_trees": {"maxIter": 5, "maxDepth": 3}, "random_forest": {"numTrees": 5, "maxDepth": 4}}


@pytest.fixture(scope="module")
def rows(spark):
    hours = spark.range(240).select(
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
        F.explode(F.array(F.lit("Delhi"), F.lit("Pune"))).alias("city"),
    )
    value = 100 + 50 * F.sin(F.col("seq") / 24 * 6.283185307179586) + F.when(F.col("city") == "Pune", 20).otherwise(0)
    return features.prior_features(hours.withColumn("aqi", value)).cache()


@pytest.fixture(scope="module")
def trained(rows):
    return models.train_all(rows, FAST, cv_folds=2)


def test_training(spark, rows, trained):
    assert set(trained) == {"boosted_trees", "random_forest"}
    for t in trained.values():
        assert t.rows == 480 and set(t.cv) == {"rmse_mean", "mae_mean", "r2_mean"}
    assert trained["random_forest"].parameters["numTrees"] == 5
    assert trained["random_forest"].parameters["featureSubsetStrategy"] == "all"
    assert models.training_runs(spark, trained).count() == 2
    assert models.best_trained(spark, trained, "rmse") in trained
    with pytest.raises(ValueError):
        models.best_trained(spark, trained, "speed")
    with pytest.raises(ValueError):
        models.train("other", rows)
    with pytest.raises(ValueError):
        models.train("random_forest", rows.limit(0))
    assert models.evaluate_all(trained, rows).count() == 2
    assert models.cross_validate("random_forest", rows, 2, parameters=FAST["random_forest"]).count() == 2


def test_prediction_and_importance(spark, rows, trained):
    scored = models.predict(trained["boosted_trees"], rows)
    assert scored.where("prediction is null").count() == 0 and "features" not in scored.columns
    everything = models.model_feature_importance(trained["random_forest"], spark).collect()
    assert len(everything) == len(models.MODEL_FEATURES)
    values = [r["importance"] for r in everything]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1.0)
    assert models.model_feature_importance(trained["random_forest"], spark, 5).count() == 5


def test_forecast(spark, rows, trained):
    t = trained["random_forest"]
    made = models.forecast_24h(t, rows, sigma=2.0)
    got = {(r["city"], r["timestamp"]): r for r in made.collect()}
    assert len(got) == 48
    last = rows.agg(F.max("timestamp")).first()[0]
    hours = sorted((stamp - last).total_seconds() / 3600 for city, stamp in got if city == "Pune")
    assert hours == list(range(1, 25))
    assert all(r["upper_bound"] - r["predicted_aqi"] == pytest.approx(3.92) for r in got.values())
    # the first step equals a prediction on the features that the next row would have
    following = rows.select("seq", "city", "timestamp", "aqi").unionByName(
        spark.createDataFrame([(240, "Pune"), (240, "Delhi")], "seq long, city string").select(
            "seq", "city", F.timestamp_seconds(F.col("seq") * 3600).alias("timestamp"), F.lit(None).cast("double").alias("aqi")
        )
    )
    expected = models.predict(t, features.prior_features(following).where("seq = 240"))
    for r in expected.collect():
        assert got[r["city"], r["timestamp"]]["predicted_aqi"] == pytest.approx(r["prediction"])


def test_registry(spark, trained, tmp_path):
    store = ModelRegistry(spark, str(tmp_path))
    assert store.models().count() == 0
    first = store.register(trained["boosted_trees"], "trees", "v1.0", {"rmse": 12.0, "mae": 9.0, "r2": 0.80})
    second = store.register(trained["random_forest"], "trees", "v2.0", {"rmse": 10.5, "mae": 8.2, "r2": 0.85})
    assert first == "trees_v1.0"
    assert store.models("trees").count() == 2 and store.models("other").count() == 0
    assert store.best("r2")["version"] == "v2.0" and store.best("rmse")["metrics"]["rmse"] == 10.5
    assert store.info(first)["model_type"] == "boosted_trees"
    again = ModelRegistry(spark, str(tmp_path))
    assert again.get(second).columns == trained["random_forest"].columns
    assert rows_of(store.stats()) == [
        ("all", None, 2), ("name", "trees", 2), ("type", "boosted_trees", 1), ("type", "random_forest", 1),
    ]
    store.delete(second)
    assert again.models().count() == 1
    for call in (store.get, store.delete, store.info):
        with pytest.raises(ValueError):
            call(second)


def test_scoring_marks_errors(spark, rows, trained):
    t = trained["random_forest"]
    df = rows.limit(4).withColumn("error", F.when(F.col("seq") == 0, "bad"))
    df = df.withColumn("ingest_time", F.timestamp_seconds(F.lit(10)))
    made = score(df, t.model, t.columns, now=F.timestamp_seconds(F.lit(11.5))).collect()
    assert all((r["predicted_aqi"] is None) == (r["error"] is not None) for r in made)
    assert all(r["features_computed"] == (r["error"] is None) and r["latency_ms"] == 1500.0 for r in made)


def test_training_rows_are_written_once(spark, monkeypatch):
    """Splits, fits and scores read the written table; the windows over the readings are not planned again."""
    from tests.conftest import SMALL
    from zephyra.workload import queries

    made = queries._training_rows(spark, SMALL)
    monkeypatch.setattr(queries.features, "prior_features", lambda *a, **k: pytest.fail("windows again"))
    assert queries._training_rows(spark, SMALL) is made and made.count() > 0
