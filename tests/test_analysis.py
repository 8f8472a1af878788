from __future__ import annotations

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import by_seq, rows_of
from zephyra.operators import evaluate, profile, splits


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "ab"[i % 2], float(i * 7 % 23), float(i), -2.0 * i, 1.0) for i in range(60)]
    rows.append((60, "a", 1000.0, None, 3.0, 1.0))
    return spark.createDataFrame(rows, "seq long, city string, aqi double, x double, y double, constant double")


COLUMNS = ["aqi", "x", "y", "constant"]


def test_statistics_match_pandas(table):
    frame = table.select(*COLUMNS).toPandas()
    found = {(r["feature"], r["stat"]): r["value"] for r in profile.feature_statistics(table, COLUMNS).collect()}
    described = frame.describe()
    for c in COLUMNS:
        for stat in described.index:
            assert found[c, stat] == pytest.approx(described[c][stat])
        assert found[c, "skewness"] == pytest.approx(frame[c].skew())
        assert found[c, "kurtosis"] == pytest.approx(frame[c].kurtosis())
        assert found[c, "null_count"] == frame[c].isna().sum()
    medians = {r["feature"]: r["value"] for r in profile.feature_distributions(table, COLUMNS).collect() if r["stat"] == "median"}
    assert medians == frame.median().to_dict()


def test_correlations_match_pandas(table):
    frame = table.select(*COLUMNS).toPandas()
    expected = frame.corr()
    found = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation_matrix(table, COLUMNS).collect()}
    assert len(found) == 16
    for a in COLUMNS:
        for b in COLUMNS:
            if "constant" in (a, b):
                assert found[a, b] is None and math.isnan(expected[a][b])
            else:
                assert found[a, b] == pytest.approx(expected[a][b])
    ordered = profile.target_correlations(table, "x", COLUMNS).collect()
    assert [r["feature"] for r in ordered][0] == "x" and ordered[-1]["r"] is None
    assert profile.correlation_matrix(table, COLUMNS, include_target=False).count() == 9


def test_importance_spans_zero_to_one(table):
    values = {r["feature"]: r["importance"] for r in profile.feature_importance(table, "x", ["aqi", "x", "y"]).collect()}
    assert values["x"] == 1.0 and min(values.values()) == 0.0
    with pytest.raises(ValueError):
        profile.feature_importance(table, "nope")


def test_outliers(table):
    found = profile.outliers_iqr(table, ["seq"], COLUMNS)
    assert (60, 1000.0) in rows_of(found.where("feature = 'aqi'"), "seq", "value")
    assert rows_of(profile.outliers_zscore(table, ["seq"], ["aqi", "constant"], 3.0), "feature", "seq") == [("aqi", 60)]
    with pytest.raises(ValueError):
        profile.outliers(table, ["seq"], "other")


def test_groups_pairs_variance(table):
    groups = {(r["feature"], r["scope"], r["city"]): r for r in profile.group_consistency(table, "city", ["x"]).collect()}
    assert groups["x", "global", None]["count"] == 61
    assert groups["x", "group", "a"]["count"] == 31  # the null counts
    assert groups["x", "group", "a"]["mean"] == pytest.approx(29.0)
    assert rows_of(profile.high_correlation_pairs(table, 0.7, "aqi", COLUMNS), "feature_a", "feature_b") == [("x", "y")]
    assert rows_of(profile.low_variance_features(table, 0.01, COLUMNS), "feature") == [("constant",)]


def test_report(table):
    sections = {r["section"] for r in profile.analysis_report(table, ["seq"], columns=COLUMNS).collect()}
    assert sections == {
        "summary", "statistics", "distributions", "target_correlations", "correlation_matrix", "importance", "outliers",
    }


@pytest.fixture(scope="module")
def days(spark):
    return spark.range(100).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 86400).alias("timestamp")
    )


def test_holdout(days):
    sizes = lambda d: dict(rows_of(d.groupBy("role").count()))
    assert sizes(splits.holdout_split(days, 0.2)) == {"train": 80, "test": 20}
    assert sizes(splits.holdout_split(days, 0.3)) == {"train": 70, "test": 30}
    assert sizes(splits.holdout_split(days)) == {"train": 75, "test": 25}
    for wrong in (0, 1, -0.1):
        with pytest.raises(ValueError):
            splits.holdout_split(days, wrong)


def test_folds(days):
    made = splits.expanding_folds(days)
    assert rows_of(made, "fold", "role", "seq") == rows_of(splits.expanding_folds(days), "fold", "role", "seq")
    sizes = dict(((f, r), n) for f, r, n in rows_of(made.groupBy("fold", "role").count()))
    assert sizes == {(1, "train"): 25, (1, "test"): 25, (2, "train"): 50, (2, "test"): 25, (3, "train"): 75, (3, "test"): 25}
    assert all(r["no_leakage"] for r in splits.leakage_check(made).collect())
    with pytest.raises(ValueError):
        splits.expanding_folds(days.limit(3), 3)
    with pytest.raises(ValueError):
        splits.expanding_folds(days, 0)


def test_leakage_is_seen_and_time_mode_avoids_it(spark):
    df = spark.range(40).select(F.col("id").alias("seq"), F.timestamp_seconds(F.floor(F.col("id") / 7) * 60).alias("timestamp"))
    assert not any(r["no_leakage"] for r in splits.leakage_check(splits.expanding_folds(df)).collect())
    assert all(r["no_leakage"] for r in splits.leakage_check(splits.expanding_folds(df, mode="time")).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(8, 60), st.integers(1, 4))
def test_folds_grow_and_do_not_overlap(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") % 5).alias("timestamp"))
    rows = splits.expanding_folds(df, k).orderBy("timestamp", "seq").collect()
    order = {r["seq"]: i for i, r in enumerate(df.orderBy("timestamp", "seq").collect())}
    size = n // (k + 1)
    for fold in range(1, k + 1):
        train = sorted(order[r["seq"]] for r in rows if r["fold"] == fold and r["role"] == "train")
        test = sorted(order[r["seq"]] for r in rows if r["fold"] == fold and r["role"] == "test")
        assert train == list(range(size * fold)) and test == list(range(size * fold, size * (fold + 1)))


@pytest.fixture
def scored(spark):
    def make(actual, predicted):
        rows = [(i, a, p) for i, (a, p) in enumerate(zip(actual, predicted))]
        return spark.createDataFrame(rows, "seq long, y_true double, y_pred double")

    return make


def test_metrics(scored):
    y = [1.0, 2.0, 3.0, 4.0, 5.0]
    perfect = evaluate.checked_metrics(scored(y, y)).first()
    assert (perfect["rmse"], perfect["mae"], perfect["r2"], perfect["mape"]) == (0.0, 0.0, 1.0, 0.0)
    constant = evaluate.checked_metrics(scored(y, [3.0] * 5)).first()
    assert constant["r2"] <= 0 and constant["rmse"] == pytest.approx(2**0.5)
    zero = evaluate.regression_metrics(scored([0.0, 2.0], [1.0, 1.0])).first()
    assert zero["mape"] == 50.0
    for bad in (scored([], []), scored([1.0], [None])):
        with pytest.raises(ValueError):
            evaluate.checked_metrics(bad)


def test_errors_and_residuals(scored):
    df = scored([1.0, 2.0, 3.0, 10.0], [1.5, 2.0, 2.0, 2.0])
    residuals = pd.Series([-0.5, 0.0, 1.0, 8.0])
    found = evaluate.residual_analysis(df).first()
    assert found["residual_mean"] == pytest.approx(residuals.mean())
    assert found["residual_std"] == pytest.approx(residuals.std(ddof=0))
    stats = {r["measure"]: r for r in evaluate.error_statistics(df).collect()}
    assert stats["error"]["median"] == pytest.approx(residuals.abs().median())
    assert stats["error"]["q75"] == pytest.approx(residuals.abs().quantile(0.75))
    assert by_seq(evaluate.residual_outliers(df, 2.0), "seq") == [3]
    assert {r["name"]: r["value"] for r in evaluate.evaluation_report(df).collect()}["n_outliers"] == 1.0


def test_comparison(spark):
    rows = [("a", 10.5, 8.2, 0.85), ("b", 12.3, 9.1, 0.80), ("c", 9.8, 7.5, 0.88), ("d", None, None, None)]
    table = spark.createDataFrame(rows, "model string, rmse double, mae double, r2 double")
    assert [r["model"] for r in evaluate.compare_models(table).collect()] == ["c", "a", "b", "d"]
    for metric in ("r2", "rmse", "mae"):
        assert evaluate.best_model(table, metric).first()["model"] == "c"
    with pytest.raises(ValueError):
        evaluate.best_model(table, "speed")
