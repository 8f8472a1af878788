from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_seq, rows_of
from zephyra.functions.rounding import fixed_text, round_half_even
from zephyra.operators import clean, quality
from zephyra.schemas import CATEGORIES

AT = datetime(2024, 1, 1)


@pytest.fixture
def make(spark):
    def build(*rows):
        rows = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "seq long, city string, timestamp timestamp, aqi double")

    return build


def at(hour):
    return AT.replace(hour=hour)


def test_each_step_rejects_its_row(make):
    df = make(
        ("Delhi", at(0), 150.0), ("Delhi", at(0), 160.0), ("Delhi", at(1), -10.0), ("Delhi", at(2), 550.0),
        (None, at(3), 100.0), ("Delhi", None, 100.0), ("Delhi", at(4), None), ("Delhi", at(5), 0.0),
        ("Delhi", at(6), 500.0), ("Delhi", at(3), 90.0),
    )
    assert by_seq(clean.clean(df), "seq") == [0, 7, 8]
    counts = dict(rows_of(clean.rejection_counts(df)))
    assert counts == {"duplicate": 1, "missing": 3, "out_of_range": 2, "out_of_order": 1, "valid": 3}


def test_late_rows_are_judged_by_arrival_and_city(make):
    df = make(("Delhi", at(1), 150.0), ("Delhi", at(0), 160.0), ("Mumbai", at(0), 120.0), ("Mumbai", at(1), 130.0))
    assert by_seq(clean.reject_out_of_order(df), "seq") == [0, 2, 3]
    jump = make(("Delhi", at(5), 1.0), ("Delhi", at(1), 1.0), ("Delhi", at(2), 1.0))
    assert by_seq(clean.reject_out_of_order(jump), "seq") == [0]
    assert by_seq(clean.reject_out_of_order(jump, mode="previous"), "seq") == [0, 2]


def test_rejected_rows_do_not_move_the_clock(make):
    df = make(("Delhi", at(9), 900.0), ("Delhi", at(1), 10.0))
    assert by_seq(clean.clean(df), "seq") == [1]
    assert dict(rows_of(clean.rejection_counts(df)))["valid"] == 1


def test_pollutant_widens_the_key(make):
    df = make(("Delhi", at(0), 1.0), ("Delhi", at(0), 2.0))
    assert clean.deduplicate(df).count() == 1
    assert clean.deduplicate(df.withColumn("pollutant_type", F.col("seq").cast("string"))).count() == 2


def test_dedup_limits_groups_before_the_shuffle(small):
    plan = clean.deduplicate(small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_gate(spark, make):
    good = make(("Delhi", at(0), 1.0))
    assert clean.schema_gate(good) is good
    for bad in (
        good.drop("aqi"), good.withColumn("aqi", F.lit("x")), good.withColumn("timestamp", F.lit("x")),
        good.withColumn("city", F.lit(1)), good.limit(0),
    ):
        with pytest.raises(clean.SchemaError):
            clean.schema_gate(bad)
    counted = clean.gate_counts(make(("Delhi", at(0), 600.0), (None, at(0), 1.0))).first()
    assert (counted["out_of_range"], counted["null_city"]) == (1, 1)


def test_flags(make):
    df = make(("Delhi", at(1), 1.0), ("Delhi", at(1), 700.0), ("Delhi", at(0), None))
    flagged = clean.quality_flags(df)
    assert dict(flagged.dtypes)["quality_flags"] == "array<string>"
    assert by_seq(flagged, "quality_flags") == [[], ["out_of_range", "duplicate"], ["missing", "out_of_order"]]


def test_categories(make):
    values = [-1.0, 0.0, 50.0, 50.5, 51.0, 100.0, 150.0, 250.0, 300.5, 350.0, 500.0, 501.0, None]
    df = make(*[("Delhi", at(0), v) for v in values])
    names = [c[0] for c in CATEGORIES]
    g, s, m, h, v = names
    assert by_seq(clean.add_category(df), "category") == [None, g, g, None, s, s, m, h, None, v, v, None, None]
    assert by_seq(clean.add_category(df, mode="continuous"), "category") == [None, g, g, s, s, s, m, h, v, v, v, v, None]
    attributes = clean.category_attributes(clean.add_category(df))
    assert by_seq(attributes, "alert_level")[2] == "none"
    with pytest.raises(ValueError):
        clean.add_category(df, mode="other")


def test_score(make):
    df = make(("Delhi", at(0), 1.0), ("Delhi", at(1), None), ("Delhi", at(2), 3.0), ("Delhi", at(3), 4.0))
    assert quality.quality_score(df).first()["quality_score"] == 75.0
    doubled = make(("Delhi", at(0), None), ("Delhi", at(0), 900.0))
    assert quality.quality_score(doubled).first()["quality_score"] == -50.0
    assert quality.quality_score(doubled, mode="rows").first()["quality_score"] == 0.0
    empty = quality.quality_summary(df.limit(0))
    assert empty.first()["quality_score"] == 0.0
    assert rows_of(quality.quality_alerts(empty), "level") == [("critical",)]


def test_alerts_and_advice(make):
    bad = make(("Delhi", at(0), None), ("Delhi", at(0), 900.0))
    summary = quality.quality_summary(bad)
    assert rows_of(quality.quality_alerts(summary)) == [
        ("info", "Found 1 duplicate records"),
        ("warning", "Found 1 missing values in 1 columns"),
        ("warning", "Found 1 out-of-range values"),
        ("warning", "Quality score below 80%: -50.00%"),
    ]
    assert quality.quality_recommendations(summary).count() == 4
    good = quality.quality_summary(make(("Delhi", at(0), 1.0)))
    assert quality.quality_alerts(good).count() == 0
    assert rows_of(quality.quality_recommendations(good)) == [(0, "Data quality is good. Continue monitoring.")]


def test_profiles(make):
    df = make(("Delhi", at(0), 1.0), ("Delhi", at(1), None), ("Mumbai", at(1), 5.0))
    assert rows_of(quality.missing_by_column(df)) == [("aqi", 1)]
    assert rows_of(quality.group_profile(df)) == [("Delhi", 2, 1, 1.0, 1.0), ("Mumbai", 1, 0, 5.0, 5.0)]
    profile = {r["column"]: r for r in quality.column_profile(df).collect()}
    assert (profile["aqi"]["missing"], profile["aqi"]["distinct"], profile["city"]["type"]) == (1, 2, "string")
    assert quality.column_profile(df, approximate=True).count() == 4
    assert set(r["section"] for r in quality.quality_report(df).collect()) == {
        "summary", "column", "alert", "recommendation", "city",
    }


def test_run_metrics(spark):
    metrics = quality.RunMetrics("r1")
    with metrics.stage("gold"):
        pass
    metrics.values["valid_records"] = 3
    rows = metrics.table(spark).collect()
    assert {r["operation"] for r in rows} == {"gold", "total", None}
    assert {r["measure"]: r["value"] for r in rows if r["measure"]} == {"valid_records": 3.0, "within_target": 1.0}


def test_rounding_follows_the_exact_value(spark):
    values = [0.05, 0.15, 0.25, 0.35, 122.25, 122.35, 122.75, 2.675, 1e9 + 0.05, 0.0, 99.95, 7.0, -0.25, -0.35, -12.34]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, v double")
    assert by_seq(df.select("seq", fixed_text(F.col("v"), 1).alias("t")), "t") == [f"{v:.1f}" for v in values]
    assert by_seq(df.select("seq", round_half_even(F.col("v"), 2).alias("t")), "t") == [round(v, 2) for v in values]
