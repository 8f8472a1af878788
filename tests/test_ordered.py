"""The plans for large keys give what the plain windows give."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows_of
from zephyra.functions.columns import long_rows
from zephyra.operators import alerts, clean, features, splits
from zephyra.plans.hours import trailing
from zephyra.plans.ordered import chunk_rows, number_rows, rows_at
from zephyra.plans.quantiles import quantiles
from zephyra.schemas import LAG_FEATURES, ROLLING_FEATURES

LIMIT = 40  # far below the rows of a city, so that every key is cut


def same(plain, cut, *columns):
    near = lambda row: [None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in row]
    left, right = rows_of(plain, *columns), rows_of(cut, *columns)
    assert len(left) > 0
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert list(a) == near(b)


def test_numbering_is_the_row_number_of_the_key(small):
    numbered = number_rows(small.select("city", "seq"), ["city"], ["seq"], 9)
    expected = small.select(
        "city", "seq", (F.row_number().over(Window.partitionBy("city").orderBy("seq")) - 1).cast("long").alias("_row")
    )
    assert rows_of(numbered, "city", "seq", "_row") == rows_of(expected)


def test_numbering_splits_one_instant_and_keeps_null_keys(spark):
    rows = spark.range(500).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "a").alias("city"), F.lit(7).alias("at")
    )
    numbered = number_rows(rows, ["city"], ["at", "seq"], 8)
    assert rows_of(numbered.groupBy("city").agg(F.min("_row"), F.max("_row"), F.count_distinct("_row"))) == [
        (None, 0, 249, 250),
        ("a", 0, 249, 250),
    ]


def test_small_keys_take_the_plain_plan(small):
    assert chunk_rows(small, ["city"], ["seq"], 10_000) is None


@pytest.mark.parametrize("limit", [24, LIMIT])
def test_lags_and_rolling_windows(small, limit):
    same(features.lag_rows(small), features.lag_rows(small, limit=limit), "seq", *LAG_FEATURES)
    same(features.rolling_rows(small), features.rolling_rows(small, limit=limit), "seq", *ROLLING_FEATURES)


def test_gold(small):
    silver = clean.clean(small)
    columns = ["seq", "aqi", "pm25", *LAG_FEATURES, *ROLLING_FEATURES, "season"]
    plain, cut = features.build_gold(silver), features.build_gold(silver, limit=LIMIT)
    assert cut.columns == plain.columns
    numbers = columns[:-1]
    same(plain, cut, *numbers)
    assert rows_of(plain, "seq", "season") == rows_of(cut, "seq", "season")


def test_out_of_order(small):
    for mode in ("running", "previous"):
        plain = clean.mark_out_of_order(small, mode=mode)
        cut = clean.mark_out_of_order(small, mode=mode, limit=LIMIT)
        assert rows_of(plain, "seq", "late") == rows_of(cut, "seq", "late")


def test_fill(small):
    sparse = small.withColumns(
        {
            "aqi": F.when(F.col("seq") % 5 == 0, F.col("aqi")),
            "pm25": F.when((F.col("seq") > 300) & (F.col("seq") % 90 == 0), F.col("pm25")),
        }
    )
    sparse = sparse.withColumn("co", F.lit(None).cast("double"))
    columns = ["aqi", "pm25", "co", "source"]
    plain = features.fill_missing(sparse, columns)
    cut = features.fill_missing(sparse, columns, limit=LIMIT)
    assert rows_of(plain, "seq", *columns) == rows_of(cut, "seq", *columns)
    assert plain.where("aqi is null or pm25 is null or co <> 0").count() == 0


def test_clean_and_counts(small):
    assert rows_of(clean.clean(small), "seq") == rows_of(clean.clean(small, limit=LIMIT), "seq")
    assert rows_of(clean.rejection_counts(small)) == rows_of(clean.rejection_counts(small, limit=LIMIT))


@pytest.mark.parametrize("hours", [1, 24])
def test_suppression(small, hours):
    found = alerts.rule_alerts(small)
    plain = alerts.suppress_repeats(found, hours)
    cut = alerts.suppress_repeats(found, hours, limit=12)
    assert rows_of(plain, "seq") == rows_of(cut, "seq")


def test_rows_at_and_folds(small):
    everything = rows_at(small, ["timestamp", "seq"], [0, 400, 999])
    cut = rows_at(small, ["timestamp", "seq"], [0, 400, 999], limit=100)
    assert rows_of(everything) == rows_of(cut)
    plain = splits.expanding_folds(small)
    assert rows_of(plain, "fold", "role", "seq") == rows_of(
        splits.expanding_folds(small, limit=100), "fold", "role", "seq"
    )


def test_quantiles_by_bins(spark, small):
    skewed = small.select("city", "aqi", F.exp(F.col("aqi") / 10).alias("wide"), F.lit(3.0).alias("constant"))
    skewed = skewed.unionByName(skewed.withColumn("aqi", F.lit(7.5)))  # half of the rows hold one value
    columns, p = ["aqi", "wide", "constant"], [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    for keys in ([], ["city"]):
        plain = quantiles(skewed, columns, p, keys)
        binned = quantiles(skewed, columns, p, keys, limit=0)
        order = [*keys, "feature", "p", "value"]
        left, right = rows_of(plain, *order), rows_of(binned, *order)
        assert [r[:-1] for r in left] == [r[:-1] for r in right]
        assert [r[-1] for r in left] == pytest.approx([r[-1] for r in right], rel=1e-12)


def brute(rows, hours, closed):
    """Trailing statistics straight from the definition."""
    made = {}
    for city, us, _ in rows:
        for n in hours:
            start = us - n * 3_600_000_000
            part = [
                v
                for c, t, v in rows
                if c == city and v is not None
                and (t > start or (closed == "both" and t == start))
                and (t < us or (closed != "neither" and t == us))
            ]
            mean = sum(part) / len(part) if part else None
            std = (sum((v - mean) ** 2 for v in part) / len(part)) ** 0.5 if part else None
            made[city, us, n] = (len(part), mean, std, min(part, default=None), max(part, default=None))
    return made


@pytest.mark.parametrize("closed", ["neither", "both", "right"])
def test_hours_against_brute_force(spark, closed):
    """Ties, whole-hour distances, empty hours, constant runs, null values, times before 1970."""
    hour = 3_600_000_000
    offsets = [0, 0, 1, hour, hour, hour + 5, 3 * hour, 3 * hour, 3 * hour + 1, 27 * hour, 27 * hour + 7, 30 * hour]
    values = [29.27, 30.0, None, 5.0, 5.0, 5.0, None, 2.0, 29.27, 1e6, 1e6, 1e6 + 0.5]
    rows = [("a", o - 10 * hour, v) for o, v in zip(offsets, values)] + [(None, o, v) for o, v in zip(offsets, values)]
    table = [(i, c, t, v) for i, (c, t, v) in enumerate(rows)]
    df = spark.createDataFrame(table, "seq long, city string, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    found = trailing(df, ["city"], "ts", "v", "seq", [1, 3, 24], [3, 24], closed)
    expected = brute(rows, [3, 24], closed)
    city = F.when(~F.col("_z0"), F.col("_k0")).alias("city")
    got = found.select(city, F.col("_us").alias("us"), *found.columns[3:]).collect()
    assert len(got) == len({(c, t) for c, t, _ in rows})
    for r in got:
        for n in (3, 24):
            e = expected[r["city"], r["us"], n]
            assert (r[f"count_{n}"], r[f"min_{n}"], r[f"max_{n}"]) == (e[0], e[3], e[4])
            assert r[f"mean_{n}"] == pytest.approx(e[1])
            assert r[f"std_{n}"] == pytest.approx(e[2], abs=1e-9)
        for n in (1, 3, 24):
            known = [(t, i, v) for i, c, t, v in table if c == r["city"] and v is not None and t <= r["us"] - n * hour]
            assert r[f"lag_{n}"] == (max(known)[2] if known else None)


def test_hours_group_instants_before_the_shuffle(small):
    """One instant with most of the rows reaches the windows as a single row."""
    plan = trailing(small, ["city"], "timestamp", "aqi", "seq", [], [3])._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "partial_count" in plan[first_exchange:]


def test_crowded_instants_are_spread(spark, small):
    """Most rows at one instant, and a limit below that: the same answers, from a salted join."""
    crowd = small.withColumn("timestamp", F.when(F.col("seq") % 3 > 0, F.timestamp_seconds(F.lit(1704800000))).otherwise(F.col("timestamp")))
    plain, cut = features.event_features(crowd), features.event_features(crowd, limit=20)
    assert "_share" in cut._jdf.queryExecution().toString() and "_share" not in plain._jdf.queryExecution().toString()
    same(plain, cut, "seq", *LAG_FEATURES, *ROLLING_FEATURES)


def test_long_rows(small):
    assert long_rows(small, ["aqi", "pm25"], "seq").count() == 2 * small.count()
