"""Exact quantiles against numpy, in one step and by descending into cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.quantiles import attach, quantile_values, quantiles

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def want(values):
    return np.quantile(values, PROBABILITIES)


@pytest.fixture(params=["whole", "cells"])
def cells(request, monkeypatch):
    if request.param == "cells":
        monkeypatch.setattr(ranges, "ROWS", 50)
        monkeypatch.setattr(ranges, "MOST", 4)  # so several rounds of cuts are needed


def test_by_groups(spark, cells):
    rng = random.Random(1)
    kinds = {"even": lambda: rng.random(), "ties": lambda: rng.choice([1.0, 2.0, 7.5]), "one": lambda: 4.0, None: lambda: rng.gauss(0, 9)}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(rng.randint(150, 300))] + [("even", None), ("even", float("nan")), ("empty", None), ("single", -3.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r.k: r for r in quantiles(df, "x", PROBABILITIES, ["k"]).collect()}
    assert set(got) == {*kinds, "single"}
    for k, r in got.items():
        values = [x for key, x in rows if key == k and x is not None and x == x]
        assert r.n == len(values)
        assert list(r.q) == pytest.approx(want(values), abs=1e-12)
    told = attach(df.groupBy("k").agg(F.count("*").alias("rows")), quantiles(df, "x", [0.5], ["k"]), ["k"]).collect()
    assert {r.k for r in told} == {*kinds, "single", "empty"} and next(r.q for r in told if r.k == "empty") is None


def test_whole_column(spark, cells):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(700)], [5.0] * 400 + [1.0, 9.0], [3.0], list(range(333))):
        df = spark.createDataFrame([(float(x),) for x in values], "x double")
        assert quantile_values(df, "x", PROBABILITIES) == pytest.approx(want(values), abs=1e-12)
    assert quantile_values(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) is None


def test_a_million_different_values(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 20_000)
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    kept, held = [], ranges.kept
    monkeypatch.setattr(ranges, "kept", lambda d: kept.append(held(d)) or kept[-1])
    assert quantile_values(df, "x", [0.25, 0.5, 0.9]) == pytest.approx(np.quantile(np.arange(n), [0.25, 0.5, 0.9]))
    # behind the first table of all values only a few cells of it are left
    assert sorted(d.count() for d in kept)[-2] < n // 8


def test_small_groups_are_sorted_in_one_exchange(spark, monkeypatch):
    """Beside a group that is cut into cells, small ones are sorted and numbered; no cut is made for them."""
    monkeypatch.setattr(ranges, "ROWS", 100)
    small = [(f"g{k}", float(k * 7 + i * i)) for k in range(60) for i in range(5)]
    cuts, whole = [], ranges.cuts_of
    monkeypatch.setattr(ranges, "cuts_of", lambda *a: cuts.append(a) or whole(*a))
    plan = quantiles(spark.createDataFrame(small, "k string, x double"), "x", [0.5, 0.9], ["k"])
    for r in plan.collect():
        assert list(r.q) == pytest.approx(np.quantile([x for k, x in small if k == r.k], [0.5, 0.9]))
    assert not cuts and plan.count() == 60
    rows = small + [("hot", float(i % 211)) for i in range(400)]
    got = {r.k: list(r.q) for r in quantiles(spark.createDataFrame(rows, "k string, x double"), "x", [0.5, 0.9], ["k"]).collect()}
    assert cuts and len(got) == 61
    for key, q in got.items():
        assert q == pytest.approx(np.quantile([x for k, x in rows if k == key], [0.5, 0.9]))
