"""Fits side by side, fold scores, and the history of trainings."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from zephyra.operators import models

STUMP = {"maxDepth": 1, "maxIter": 1}


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(200).select(
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
        (F.col("id") % 10).cast("int").alias("a"),
        (F.col("id") % 7).cast("int").alias("b"),
    )
    return made.withColumn("aqi", F.when(F.col("a") >= 6, 100.0).otherwise(20.0) + F.col("b") * 0.5).cache()


def test_results_in_order_and_at_most_so_many_at_once(spark):
    running, most, lock = 0, 0, threading.Lock()

    def work(i):
        def run():
            nonlocal running, most
            with lock:
                running += 1
                most = max(most, running)
            time.sleep(0.05)
            with lock:
                running -= 1
            return spark.range(i).count()

        return run

    assert models.side_by_side(spark, [work(i) for i in range(8)], 3) == list(range(8))
    assert 1 < most <= 3
    assert models.side_by_side(spark, [work(5)], 3) == [5] and models.side_by_side(spark, [], 3) == []
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_a_failure_is_raised(spark):
    def wrong():
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        models.side_by_side(spark, [lambda: 1, wrong, lambda: 2], 2)


def test_a_tree_of_one_split(rows):
    trained = models.train("boosted_trees", rows, ["a", "b"], parameters=STUMP, cv_folds=3)
    made = models.predict(trained, rows)
    high, low = (rows.where(c).agg(F.avg("aqi")).first()[0] for c in ("a >= 6", "a < 6"))
    for r in made.collect():
        assert r["prediction"] == pytest.approx(high if r["a"] >= 6 else low)
    folds = models.cross_validate("boosted_trees", rows, 3, ["a", "b"], parameters=STUMP, at_once=1)
    together = models.cross_validate("boosted_trees", rows, 3, ["a", "b"], parameters=STUMP, at_once=3)
    assert rows_of(folds) == rows_of(together) and [r["fold"] for r in folds.collect()] == [1, 2, 3]
    for m in ("rmse", "mae", "r2"):
        assert trained.cv[f"{m}_mean"] == pytest.approx(sum(r[m] for r in folds.collect()) / 3)


def test_history(spark, rows, tmp_path):
    path = f"{tmp_path}/runs"
    assert models.training_history(spark, path).count() == 0
    parameters = {"boosted_trees": STUMP, "random_forest": {"maxDepth": 1, "numTrees": 2}}
    for folds in (2, None):
        models.record_runs(spark, models.train_all(rows, parameters, folds, columns=["a", "b"]), path)
    history = models.training_history(spark, path)
    assert rows_of(history, "model", "rows", "n_features", "use_cv") == [
        ("boosted_trees", 200, 2, False), ("boosted_trees", 200, 2, True),
        ("random_forest", 200, 2, False), ("random_forest", 200, 2, True),
    ]
    assert history.where("use_cv = (rmse_mean is null)").count() == 0 and history.where("trained_at is null").count() == 0
    summary = models.training_summary(history)
    assert rows_of(summary, "model", "runs") == [("boosted_trees", 2), ("random_forest", 2)]
    assert summary.where("best_rmse is null").count() == 0


def test_tasks_of_a_pass_are_bounded(rows, monkeypatch):
    """Sums of the nodes, and messages to the driver, come from every task of every pass."""
    monkeypatch.setattr(models, "ROWS_PER_TASK", 10)
    with models._prepared(rows, ["a", "b"], "aqi", "timestamp", "seq") as ready:
        assert ready.rdd.getNumPartitions() == models.MOST_TASKS and ready.count() == 200
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    with models._prepared(rows, ["a", "b"], "aqi", "timestamp", "seq") as ready:
        assert ready.rdd.getNumPartitions() == 2
