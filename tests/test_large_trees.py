"""Trees over tables beyond what MLlib fits: splits from sums, branches grown in tasks, and both against MLlib."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyra.operators import models
from zephyra.operators.registry import ModelRegistry
from zephyra.plans import trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows with few values, so that every threshold is a candidate."""
    made = spark.range(2000).select(
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
        (F.col("id") % 11).cast("double").alias("a"),
        (F.xxhash64("id") % 7).cast("double").alias("b"),
        (F.xxhash64("id", F.lit(1)) % 13).cast("double").alias("c"),
    )
    return made.withColumn("aqi", F.col("a") * F.col("b") + F.sin("c") * 10 + (F.xxhash64("seq", F.lit(2)) % 1000) / 500).cache()


@pytest.fixture
def large(monkeypatch):
    """Several tasks, and every fit by ``plans/trees.py``."""
    monkeypatch.setattr(models, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(models, "MLLIB_ROWS", {"boosted_trees": 0, "random_forest": 0})
    monkeypatch.setattr(trees, "BLOCK_ROWS", {"boosted_trees": 100, "random_forest": 150})


def predicted(trained, rows):
    return np.array([r[0] for r in models.predict(trained, rows).orderBy("seq").select("prediction").collect()])


@pytest.mark.parametrize(
    "kind, parameters",
    [("boosted_trees", {"maxIter": 7, "maxDepth": 4}), ("random_forest", {"numTrees": 2, "maxDepth": 6, "bootstrap": False})],
)
def test_equals_mllib(rows, monkeypatch, large, kind, parameters):
    made = models.train(kind, rows, COLUMNS, parameters=parameters)
    assert isinstance(made.model, trees.Ensemble)
    monkeypatch.setattr(models, "MLLIB_ROWS", {kind: 10_000})
    other = models.train(kind, rows, COLUMNS, parameters=parameters)
    assert not isinstance(other.model, trees.Ensemble)
    assert predicted(made, rows) == pytest.approx(predicted(other, rows), rel=1e-6, abs=1e-6)
    assert made.model.featureImportances.toArray() == pytest.approx(other.model.featureImportances.toArray(), abs=1e-6)


def test_sums_and_branches_grow_the_same_forest(rows, monkeypatch, large):
    fits = []
    for limit in (1e9, 300, 0):  # branches from the root, below some splits, and none
        monkeypatch.setattr(trees, "LOCAL_ROWS", limit)
        monkeypatch.setattr(trees, "SUM_BYTES", 20_000)  # several groups of trees a level
        monkeypatch.setattr(trees, "WAVE_BYTES", 50_000)  # and several waves of rows
        fits.append(models.train("random_forest", rows, COLUMNS, parameters={"numTrees": 4, "maxDepth": 5}))
    first = predicted(fits[0], rows)
    for other in fits[1:]:
        assert predicted(other, rows) == pytest.approx(first)
        assert other.model.importance == pytest.approx(fits[0].model.importance)
    assert len({tuple(t.value) for t in fits[0].model.trees}) == 4  # each has rows of its own


def test_forest_obeys_its_limits(rows, large):
    t = models.train("random_forest", rows, COLUMNS, parameters={"numTrees": 3, "maxDepth": 4, "minInstancesPerNode": 50, "bootstrap": False})
    for tree in t.model.trees:
        assert int(tree.ids.max()).bit_length() - 1 <= 4
    sizes = models.predict(t, rows).groupBy("prediction").count().agg(F.min("count")).first()[0]
    assert sizes >= 50
    assert t.model.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_one_value_gives_one_leaf(rows, large):
    t = models.train("boosted_trees", rows.withColumn("aqi", F.lit(7.25)), COLUMNS, parameters={"maxIter": 2, "maxDepth": 3})
    assert predicted(t, rows) == pytest.approx(7.25) and len(t.model.trees[0].ids) == 1
    assert t.model.featureImportances.toArray().sum() == 0


def test_folds_and_registry(spark, rows, large, tmp_path):
    t = models.train("random_forest", rows, COLUMNS, parameters={"numTrees": 3, "maxDepth": 4}, cv_folds=2)
    assert set(t.cv) == {"rmse_mean", "mae_mean", "r2_mean"} and t.cv["r2_mean"] > 0.5
    store = ModelRegistry(spark, str(tmp_path))
    got = store.get(store.register(t, "forest", "v1", {"rmse": 1.0}))
    assert predicted(got, rows) == pytest.approx(predicted(t, rows), rel=1e-12)
    assert got.model.featureImportances == t.model.featureImportances


def test_draws_are_poisson_and_repeat():
    weights = trees._bagged(42)
    drawn = weights(3, 5, 200_000)
    assert (drawn == weights(3, 5, 200_000)).all() and (drawn != weights(4, 5, 200_000)).any()
    shares = np.bincount(drawn, minlength=4)[:4] / len(drawn)
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)


def branch_rows(n, features=12):
    """Bins of rows, of which the last features have few, and labels that depend on some of them."""
    draw = np.random.default_rng(5)
    n_cuts = [31] * (features - 4) + [23, 6, 1, 0]
    bins = np.stack([draw.integers(0, k + 1, n) for k in n_cuts]).astype(np.uint8)
    label = bins[0] * 1.0 + bins[1] * (bins[2] > 9) + draw.normal(size=n)
    return bins, label, 1.0 + draw.poisson(0.6, n), n_cuts


def ordered(branch):
    ids, feature, cut, value, importance = branch
    by = np.argsort(ids)
    return ids[by], feature[by], cut[by], value[by], importance


def test_a_level_counts_the_smaller_children_in_packs(monkeypatch):
    """Half of the rows of a level at most are counted, two features at a time as long as nodes are large."""
    bins, label, weight, n_cuts = branch_rows(40_000)
    work, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *more: work.append(len(x)) or count(x, *more))
    trees.grow(bins, label, weight, 1, 4, n_cuts, 3)
    assert sum(work) < 2 * len(n_cuts) * len(label) * 4 / 2


def test_every_way_of_counting_grows_the_same_branch(monkeypatch):
    bins, label, weight, n_cuts = branch_rows(6_000)
    grown = []
    for joint, nodes, rows in ((10**9, 256, 65_536), (1, 256, 65_536), (1, 3, 500), (50, 2, 64)):
        monkeypatch.setattr(trees, "JOINT_ROWS", joint)
        monkeypatch.setattr(trees, "BRANCH_NODES", nodes)
        monkeypatch.setattr(trees, "CACHED_ROWS", rows)
        grown.append(ordered(trees.grow(bins, label, weight, 5, 6, n_cuts, 2)))
    for other in grown[1:]:
        for a, b in zip(grown[0], other):
            assert a == pytest.approx(b)


def test_branch_equals_a_search_of_every_split():
    """The splits of a branch by brute force: greatest gain, of equal ones the first feature and cut."""
    bins, label, weight, n_cuts = branch_rows(300, 6)
    bins[1] = bins[0]  # always as good as the first
    ids, feature, cut, value, _ = ordered(trees.grow(bins, label, weight, 1, 3, n_cuts, 4))
    rows = {1: np.arange(len(label))}
    for i, node in enumerate(ids):
        r = rows[node]
        w, y = weight[r], label[r]
        assert value[i] == pytest.approx(np.average(y, weights=w))
        best = (1e-9, -1, 0)
        for f, k in enumerate(n_cuts):
            for c in range(k):
                left = bins[f, r] <= c
                if min(w[left].sum(), w[~left].sum()) >= 4:
                    parts = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
                    gain = parts - (w * y).sum() ** 2 / w.sum()
                    best = (gain, f, c) if gain > best[0] * (1 + 1e-9) else best
        expected = best[1:] if node < 8 else (-1, 0)
        assert (feature[i], cut[i]) == expected
        if feature[i] >= 0:
            left = bins[feature[i], r] <= cut[i]
            rows[2 * node], rows[2 * node + 1] = r[left], r[~left]
    assert set(rows) == set(ids.tolist())


def test_equal_labels_stay_one_leaf_below_large_ones():
    """Sums of a node that come from those of its parent have rounding of the size of the parent's; it makes no splits."""
    draw = np.random.default_rng(3)
    bins = draw.integers(0, 32, (3, 5_000)).astype(np.uint8)
    label = np.where(bins[0] < 12, 1e6 + draw.normal(size=5_000) * 1e5, 0.001)
    ids, feature, _, value, _ = ordered(trees.grow(bins, label, np.ones(5_000), 1, 8, [31] * 3, 3))
    assert feature[ids == 1] == 0 and feature[ids == 3] == -1
    assert value[ids == 3] == pytest.approx(0.001)


def test_settings_survive_writes_side_by_side(spark, rows):
    from zephyra.plans.tables import CLEANUP, write_out

    before = spark.conf.get(CLEANUP, "false")
    made = models.side_by_side(spark, [lambda: write_out(rows.select("seq")).count() for _ in range(6)], 3)
    assert made == [2000] * 6 and spark.conf.get(CLEANUP) == before
