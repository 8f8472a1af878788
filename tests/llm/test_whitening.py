"""Whitening against numpy's eigenvectors and whole numbers of any size."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import SMALL
from zephyra.llm import whitening
from zephyra.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, n long, x string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in enumerate(vectors)], SCHEMA)


def whole(vectors):
    return np.floor(np.asarray(vectors, float) * 64).astype(np.int64) + 1_000_000


def by_numpy(x):
    y = x - x.mean(0)
    values, columns = np.linalg.eigh(y.T @ y / len(x))
    return values[::-1], (y @ columns[:, ::-1]) / np.sqrt(np.maximum(values[::-1], 1e-300))


@pytest.mark.parametrize("width", [1, 2, 7, 33, 40])
def test_eigen(width):
    made = np.random.default_rng(width).normal(size=(200, width)) * np.logspace(0, 4, width)
    matrix = np.cov(made.T, bias=True).reshape(width, width)
    values, columns = whitening.eigen(matrix)
    expected = np.linalg.eigvalsh(matrix)[::-1]  # whose errors are relative to the largest
    assert np.allclose(values, expected, rtol=1e-9, atol=1e-14 * expected[0])
    assert np.allclose(columns.T @ columns, np.eye(width), atol=1e-12)
    assert np.abs(columns @ np.diag(values) @ columns.T - matrix).max() <= 1e-12 * values[0]


def test_rank_and_small_eigenvalues():
    base = np.random.default_rng(1).normal(size=(50, 3))
    values, columns = whitening.eigen(np.cov((base @ np.ones((3, 5))).T, bias=True))
    assert len(values) == 1 and columns.shape == (5, 1)
    assert len(whitening.eigen(np.zeros((4, 4)))[0]) == 0
    values, _ = whitening.eigen(np.diag([1e12, 1.0, 1e6]))
    assert np.allclose(values, [1e12, 1e6, 1.0], rtol=1e-14)


def test_query_equals_numpy(spark):
    found = QUERIES["op11_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = whole(np.stack(table.embedding))
    values, white = by_numpy(x)
    n = len(x)
    assert len(found) == n * 32 and set(found.n) == {n} and found.component.max() == 32
    assert np.abs(np.abs(found.whitened.to_numpy().reshape(n, 32)) - np.abs(white[:, :32])).max() < 1e-9
    # one sign for a whole component
    sign = np.sign(found.whitened.to_numpy().reshape(n, 32) * white[:, :32])
    assert all(len(set(sign[np.abs(white[:, k]) > 1e-6, k])) == 1 for k in range(32))
    assert np.allclose(found.explained.to_numpy().reshape(n, 32)[0], (values / values.sum())[:32], rtol=1e-9)
    assert (found.deviation.to_numpy().reshape(n, 32)[:, 0] == ((n * x - x.sum(0)) ** 2).sum(1)).all()
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-10


def test_vectors_that_take_no_part_and_repeats(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(30, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0], []]
    rows = frame(spark, [*good, *bad]).unionAll(frame(spark, good[:5])).unionAll(spark.createDataFrame([(None, good[0], 1, "")], SCHEMA))
    found, made, error = whitening.whiten(rows)
    got = found.collect()
    x = whole([*good, *good[:5], good[0]])
    assert made.found.n == len(got) == 36 and error < 1e-10
    assert made.found.sums == x.sum(0).tolist()
    assert sorted(int(r["deviation"]) for r in got) == sorted(((36 * x - x.sum(0)) ** 2).sum(1).tolist())
    assert sum(r["vec_id"] is None for r in got) == 1
    assert np.allclose(made.values, by_numpy(x)[0])
    rows = whitening.by_component(found, made, error).collect()
    assert len(rows) == 36 * 3 and {r["component"] for r in rows} == {1, 2, 3}


def test_empty_single_and_equal_vectors(spark):
    empty = whitening.by_component(*whitening.whiten(frame(spark, [])))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    for vectors in ([[1.0, 2.0]], [[0.5, 0.5]] * 4):
        rows = whitening.by_component(*whitening.whiten(frame(spark, vectors))).collect()
        assert len(rows) == 2 * len(vectors)
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(0, None, None, 0.0)}
    flat = whitening.by_component(*whitening.whiten(frame(spark, [[float(i), 0.0] for i in range(5)]))).collect()
    assert {(r["component"], round(r["explained"], 12), r["whitened"] is None) for r in flat} == {(1, 1.0, False), (2, 0.0, True)}


def test_large_numbers(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(40, 3)) * 1e12).tolist()
    found, made, error = whitening.whiten(frame(spark, vectors))
    x = whole(vectors).astype(object)
    far = ((40 * x - x.sum(0)) ** 2).sum(1)
    assert sorted(int(r["deviation"]) for r in found.collect()) == sorted(far.tolist())
    assert np.allclose(made.values, by_numpy(x.astype(float))[0], rtol=1e-9) and error < 1e-9
    rows = whitening.by_component(found, made, error).collect()
    assert all(r["deviation"] is None for r in rows)  # beyond 64 bits
    huge = whitening.whiten(frame(spark, [[1e300, 1.0], [-1e300, 2.0]]))[0].collect()
    assert len(huge) == 2 and all(r["deviation"] is None or r["deviation"] > 0 for r in huge)


def test_many_tasks_give_the_same_sums(spark):
    vectors = np.random.default_rng(9).normal(size=(500, 4)).tolist()
    one = whitening.whiten(frame(spark, vectors).coalesce(1))[1]
    many = whitening.whiten(frame(spark, vectors).repartition(16))[1]
    assert one.found == many.found and (one.values == many.values).all() and (one.vectors == many.vectors).all()
