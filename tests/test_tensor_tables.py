"""Decompositions over a table against those of a cube in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import tensor

SHAPE = "label string, x array<double>"


def cube(rng, n, rank=2, noise=0.01):
    a, b, c = (np.abs(rng.normal(size=(k, rank))) for k in (n, 4, 5))
    return np.einsum("ir,jr,kr->ijk", a, b, c) + noise * np.abs(rng.normal(size=(n, 4, 5)))


def table(spark, cubes):
    return spark.createDataFrame([(label, row.ravel().tolist()) for label, t in cubes.items() for row in t], SHAPE).repartition(3)


@pytest.mark.parametrize("nonnegative", [True, False])
def test_cp_over_a_table_equals_the_cube(spark, nonnegative):
    rng = np.random.default_rng(1)
    cubes = {"a": cube(rng, 30), "b": cube(rng, 12, rank=3)}
    rows = table(spark, cubes)
    model = tensor.cp_fit(rows, 4, 5, 2, seed=3, restarts=2, steps=6, nonnegative=nonnegative)
    draws = np.random.default_rng(3)
    starts = [tuple(np.abs(draws.normal(size=(n, 2))) for n in (4, 5)) for _ in range(2)]
    for label, t in cubes.items():
        factors, error = tensor.cp_als(t, 2, steps=6, nonnegative=nonnegative, starts=starts)
        second, third, found = model[label]
        assert found == pytest.approx(error, abs=1e-6)
        made = lambda b, c, t=t: np.einsum("ir,jr,kr->ijk", tensor._row_factors(t.reshape(len(t), -1), b, c, nonnegative), b, c)
        assert made(second, third) == pytest.approx(made(*factors[1:]), abs=1e-6)
    weights = tensor.cp_weights(rows, model, nonnegative).filter("label = 'b'").collect()
    assert len(weights) == 12
    second, third, _ = model["b"]
    for r in weights:
        assert list(r.weights) == pytest.approx(tensor._row_factors(np.array([r.x]), second, third, nonnegative)[0], rel=1e-9)


def test_cp_finds_the_parts_and_sends_sums_alone(spark):
    rng = np.random.default_rng(2)
    t = cube(rng, 4000, noise=0.0)
    model = tensor.cp_fit(table(spark, {"a": t}), 4, 5, 2, restarts=1, steps=25, tolerance=1e-7)
    assert model["a"][2] < 0.05
    assert tensor.cp_fit(spark.createDataFrame([], SHAPE), 4, 5, 2) == {}


def test_self_calibration_over_a_table(spark):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(size=(50, 12))) * np.exp(np.linspace(-1, 1, 12) ** 3)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    want, _ = tensor.self_calibrate(x, 3)
    got = tensor.self_calibrated(rows, "x", 12, 3).orderBy("i").collect()
    assert np.array([r.x for r in got]) == pytest.approx(want, rel=1e-9)
    assert tensor.self_calibrated(rows.filter(F.lit(False)), "x", 12).count() == 0
