"""Transport between whole tables against the solver on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clouds, transport


def _table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(4)
    return rng.normal(size=(60, 3)), rng.normal(0.6, 1, size=(85, 3))


@pytest.fixture(scope="module")
def solved(spark, sides):
    x, y = sides
    h, b = clouds.cloud(_table(spark, x), "id", "x", 16), clouds.cloud(_table(spark, y, 1000), "id", "x", 20)
    eps = 0.5 * float(np.median(transport.squared_cost(x, y)))
    start = clouds.starting((x[:20], y[:20]), eps, b)
    return h, b, eps, *clouds.potentials(h, b, eps, start, 1e-9)


def _values(cloud, v):
    return np.array([r.v for r in clouds.by_point(cloud, v, "v").orderBy("id").collect()])


def test_blocks_hold_all_points(solved):
    h, b, *_ = solved
    assert (h.n, h.parts, b.n, b.parts) == (60, 4, 85, 5)
    assert b.blocks.agg(F.sum("n")).first()[0] == 85 and b.blocks.agg(F.max("n")).first()[0] <= 24


def test_potentials_are_those_of_the_driver(solved, sides):
    h, b, eps, f, g, error = solved
    cost = transport.squared_cost(*sides)
    own_f, own_g = _values(h, f), _values(b, g)
    assert error <= 1e-9 and transport.marginal_error(cost, own_f, own_g, eps) == pytest.approx(error, abs=1e-12)
    want = transport.potentials(*sides, eps, 1e-10)
    assert own_f - own_f[0] == pytest.approx(np.array(want["f"]), abs=1e-7)
    assert own_g + own_f[0] == pytest.approx(np.array(want["g"]), abs=1e-7)


def test_distance_and_coordinate(spark, solved, sides):
    h, b, eps, f, g, _ = solved
    cost = transport.squared_cost(*sides)
    assert clouds.distance(h, b, f, g, eps) == pytest.approx(transport.sinkhorn_w2(cost, eps), abs=1e-6)
    q = np.random.default_rng(9).normal(size=(11, 3))
    got = clouds.coordinate(clouds.cloud(_table(spark, q), "id", "x", 4), h, b, f, g, eps).orderBy("id").collect()
    state = {"hazard": sides[0], "benign": sides[1], "kappa": 0.5, "centre": 0.0, **transport.potentials(*sides, eps, 1e-10)}
    state["centre"] = transport.coordinate_of(state, np.concatenate(sides)).mean()
    assert [r.coordinate for r in got] == pytest.approx(list(transport.coordinate_of(state, q)), abs=1e-6)


def test_merging_in_several_levels(spark, solved, sides, monkeypatch):
    h, b, eps, f, g, _ = solved
    monkeypatch.setattr(clouds, "FAN", 2)
    assert _values(h, clouds.soft_min(h, b, g, eps)) == pytest.approx(_values(h, f), abs=1e-12)


def test_without_a_start_and_with_repeated_points(spark, sides):
    x, y = sides[0][:9], sides[1][:7]
    h, b = clouds.cloud(_table(spark, np.concatenate([x, x])), "id", "x", 5), clouds.cloud(_table(spark, y), "id", "x", 5)
    steps = []
    f, g, error = clouds.potentials(h, b, 1.5, tolerance=1e-8, trace=steps)
    want = transport.potentials(x, y, 1.5, 1e-10)
    got = _values(h, f)
    assert got[:9] - got[0] == pytest.approx(np.array(want["f"]), abs=1e-6) and got[9:] == pytest.approx(got[:9])
    assert steps[-1]["marginal_l1"] == error < steps[0]["marginal_l1"]


def test_unusable(spark, sides):
    x = _table(spark, sides[0][:6])
    with pytest.raises(transport.TransportError):
        clouds.cloud(x.filter("id < 0"), "id", "x")
    one = clouds.cloud(x, "id", "x", 4)
    with pytest.raises(transport.TransportError):
        clouds.potentials(one, one, 0.0)
    with pytest.raises(transport.TransportError, match="after 1 sweeps"):
        clouds.potentials(one, clouds.cloud(x.withColumn("x", F.transform("x", lambda v: v * 2)), "id", "x", 4), 0.01, sweeps=1)
    with pytest.raises(Exception, match="finite"):
        clouds.cloud(x.withColumn("x", F.transform("x", lambda v: F.lit(float("nan")))), "id", "x")


def test_a_block_is_sent_once_for_a_group(spark):
    """What is sent grows with the blocks, not with the product of both sides'."""
    dealt = lambda parts: clouds._tiles(*[spark.range(p).select(F.col("id").cast("int").alias("block"), F.lit(1).alias("n"), F.lit(b"").alias("x"), F.lit(b"").alias("v")) for p in parts], clouds._grid(parts))
    assert dealt((12, 18)).count() * 4 == dealt((48, 72)).count() == 6 * (48 + 72)
    met = dealt((8, 11)).select("own", "block", F.spark_partition_id().alias("at"))
    pairs = met.filter("own").alias("a").join(met.filter("NOT own").alias("b"), "at").select(F.col("a.block"), F.col("b.block").alias("other"))
    assert pairs.count() == pairs.distinct().count() == 88
    assert max(-(-p // g) for p, g in zip((500, 900), clouds._grid((500, 900)))) <= clouds.HELD


def test_floats_stay_floats(spark, sides):
    x = _table(spark, sides[0]).withColumn("x", F.col("x").cast("array<float>"))
    short, long = (clouds.cloud(t, "id", "x", 16) for t in (x, x.withColumn("x", F.col("x").cast("array<double>"))))
    size = lambda c: c.blocks.agg(F.sum(F.length("x"))).first()[0]
    assert 2 * size(short) == size(long) == 60 * 3 * 8
    g = short.blocks.select("block", F.expr("cast(repeat(decode(unhex('00'), 'UTF-8'), 8 * n) as binary)").alias("v"))
    got, want = (dict(clouds.by_point(c, clouds.soft_min(c, short, g, 1.0), "v").collect()) for c in (short, long))
    assert got == pytest.approx(want, abs=1e-12)


def test_median_of_all_costs(spark, sides, monkeypatch):
    """The median is that of all pairs, wherever the search begins and however many passes it takes."""
    x, y = sides
    h, b = clouds.cloud(_table(spark, x), "id", "x", 16), clouds.cloud(_table(spark, y), "id", "x", 20)
    want = np.median(transport.squared_cost(x, y))
    for near in ((0.0, 0.0), (0.9 * want, 1.1 * want), (2 * want, 3 * want), (0.1 * want, 0.2 * want), (want, want)):
        assert clouds.median_cost(h, b, near) == pytest.approx(want, rel=1e-13)
    monkeypatch.setattr(clouds, "TAKEN", 0)
    assert clouds.median_cost(h, b, (0.9 * want, 1.1 * want)) == pytest.approx(want, rel=1e-13)
    # ties, all or half of them: the two middle costs lie far apart in the second
    cloud = lambda rows: clouds.cloud(_table(spark, np.array(rows, float)), "id", "x", 2)
    assert clouds.median_cost(cloud([[0.0]] * 4), cloud([[3.0]] * 5)) == 9 and clouds.median_cost(cloud([[0.0]] * 4), cloud([[0.0]] * 3)) == 0
    assert clouds.median_cost(cloud([[0.0]] * 4), cloud([[1.0]] * 3 + [[3.0]] * 3)) == 5


@pytest.mark.parametrize("name", ["distance_of_clouds", "transport_of_clouds"])
def test_regularisation_is_of_all_pairs(spark, tmp_path, monkeypatch, name):
    """Which vectors are references changes no result."""
    import duckdb

    from tidemark.plans import registry, trial_queries

    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 120) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    monkeypatch.setattr(trial_queries, "REFERENCES", 4)
    got = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    for a, b in zip(got, sorted(duckdb.sql(registry.ORACLES[name]).fetchall()), strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=2e-5)


def test_coordinates_of_own_points(spark, solved, sides, monkeypatch):
    """Both clouds' points and others at once, as one by one; each side is put against itself alone."""
    h, b, eps, f, g, _ = solved
    rest = clouds.cloud(_table(spark, np.random.default_rng(9).normal(size=(11, 3)), 5000), "id", "x", 4)
    want = {r.id: r.coordinate for of in (h, b, rest) for r in clouds.coordinate(of, h, b, f, g, eps).collect()}
    assert dict(clouds.coordinates(h, b, f, g, eps, rest).collect()) == pytest.approx(want, abs=1e-8)
    met, plain = [], clouds.soft_min
    monkeypatch.setattr(clouds, "soft_min", lambda points, other, *a: met.append((points.n, other.n)) or plain(points, other, *a))
    assert clouds.coordinates(h, b, f, g, eps).count() == 145 and met == [(60, 60), (85, 85)]
