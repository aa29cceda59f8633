"""Training on all rows against training in memory."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import embed


def _rows(n, seed=2):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    return rng.normal(size=(n, 5)) + y[:, None], y, rng.uniform(size=n)


def _table(spark, x, y, risk):
    rows = [(f"{i:04d}", v, int(a), float(b)) for i, (v, a, b) in enumerate(zip(x.tolist(), y, risk))]
    return spark.createDataFrame(rows, "sample_id string, x array<double>, y int, risk double").repartition(5)


def _sides(x, y, risk, first):
    """Rows of each side in the order of their digests, as z-scores of the training rows."""
    z = (x - x[:first].mean(0)) / x[:first].std(0)
    digest = [hashlib.sha256(f"{i:04d}".encode()).hexdigest() for i in range(len(x))]
    order = lambda part: sorted(part, key=digest.__getitem__)
    return [(z[o], y[o], risk[o], [digest[i] for i in o]) for o in (order(range(first)), order(range(first, len(x))))]


def test_one_step_of_one_group_is_training_in_memory(spark):
    x, y, risk = _rows(60)
    got = embed.fit_all(_table(spark, x, y, risk), "x", "y", "risk", F.col("sample_id") < "0040", epochs=4, steps=1, group=64)
    (a, b, c, _), (d, e, f, _) = _sides(x, y, risk, 40)
    w, history = embed.train(a, b, c, d, e, f, epochs=4, batch=64)
    assert got["history"] == pytest.approx(history, abs=1e-9)
    for k in w:
        assert np.array(got["weights"][k]) == pytest.approx(w[k], abs=1e-7)


def test_batches_of_groups_against_sums_in_memory(spark):
    """Brute force: the same groups by digest, their gradients weighed by rows, the same steps."""
    x, y, risk = _rows(130, 5)
    got = embed.fit_all(_table(spark, x, y, risk), "x", "y", "risk", F.col("sample_id") < "0100", epochs=2, steps=3, group=12, metric=embed.contrastive)
    sides = _sides(x, y, risk, 100)

    def groups(side):
        z, own_y, own_risk, digest = sides[side]
        many = -(-len(z) // 12)
        at = np.array([int(d[:15], 16) % many for d in digest])
        return {g: (z[at == g], own_y[at == g], own_risk[at == g]) for g in range(many) if (at == g).any()}

    train, val = groups(0), groups(1)
    w = embed.init(5, 4, 3, 7)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))

    def mean(parts):
        n = sum(len(p[0]) for p in parts)
        each = [(len(p[0]) / n, *embed.loss_and_gradient(w, *p, embed.contrastive)) for p in parts]
        return sum(s * loss for s, loss, _ in each), {k: sum(s * g[k] for s, _, g in each) for k in w}

    t, history = 0, []
    for _ in range(2):
        for step in sorted({g % 3 for g in train}):
            t += 1
            w = embed._adamw(w, m, v, mean([p for g, p in train.items() if g % 3 == step])[1], t, 1e-2, 1e-4)
        history.append(mean(list(val.values()))[0])
    assert got["history"] == pytest.approx(history, abs=1e-9)
    if history[1] < history[0]:
        assert np.array(got["weights"]["W0"]) == pytest.approx(w["W0"], abs=1e-7)


def test_every_row_is_in_one_group(spark):
    df = _table(spark, *_rows(130))
    groups, *_ = embed.training_groups(df, "x", "y", "risk", F.col("sample_id") < "0100", 3, 12)
    assert {r["train"]: r["n"] for r in groups.groupBy("train").agg(F.sum("n").alias("n")).collect()} == {True: 100, False: 30}


def test_errors(spark):
    df = _table(spark, *_rows(30))
    train = F.col("sample_id") < "0020"
    for bad in (df.filter(train), df.filter("y < 0"), df.withColumn("risk", F.when(F.col("sample_id") != "0007", F.col("risk")))):
        with pytest.raises(ValueError, match="nulls"):
            embed.fit_all(bad, "x", "y", "risk", train)
    with pytest.raises(ValueError, match="repeats"):
        embed.fit_all(df.withColumn("sample_id", F.when(train, "a").otherwise("z")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(60)))), "x", "y", "risk", F.col("sample_id") == "a", group=4)
