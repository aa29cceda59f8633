"""Fitted operators against brute force, closed forms and invariants."""

import itertools
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import cone, density, embed, events, folds, hmm, metrics, regimes, resample, spectra, tensor, transport, windows
from tidemark.sources import simulate


def frames(spark, n=12, length=15, seed=0):
    rng = random.Random(seed)
    rows = [(f"s{i}", float(t), f"{i:03d}{t:03d}", rng.gauss(0, 1), "hazard" if rng.random() < 0.3 else "benign", rng.randrange(4)) for i in range(n) for t in range(length)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, score double, label string, obs int").repartition(3)


def test_hmm_likelihood_by_enumeration():
    m = hmm.start(3, None)
    m["initial"] = np.array([0.5, 0.3, 0.2])
    obs = [0, 2, 1, 1, 0]
    total = 0.0
    for path in itertools.product(range(3), repeat=len(obs)):
        p = m["initial"][path[0]] * m["emission"][path[0], obs[0]]
        for a, b, o in zip(path, path[1:], obs[1:]):
            p *= m["transition"][a, b] * m["emission"][b, o]
        total += p
    gamma, moves, ll = hmm.smoothed(hmm.log_emission(m, obs), m)
    assert ll == pytest.approx(math.log(total))
    assert gamma.sum(1) == pytest.approx(np.ones(5)) and moves.sum() == pytest.approx(4)
    assert np.exp(hmm.filtered(hmm.log_emission(m, obs), m)[0][-1]) == pytest.approx(gamma[-1])


def test_hmm_fit_does_not_depend_on_order_and_improves(spark):
    df = frames(spark).drop("score", "label")
    a, ha = hmm.fit(df, iterations=5, tolerance=0)
    b, hb = hmm.fit(df.orderBy(F.rand(3)), iterations=5, tolerance=0)
    assert ha == pytest.approx(hb) and a["transition"] == pytest.approx(b["transition"])
    assert a["transition"][0, 2] == 0 and a["transition"].sum(1) == pytest.approx(np.ones(4))
    again = hmm.load(hmm.dump(a))
    assert again["transition"] == pytest.approx(a["transition"])
    with pytest.raises(ValueError):
        hmm.load(hmm.dump(a | {"version": "x"}))
    with pytest.raises(ValueError):
        hmm.load(hmm.dump(a | {"transition": a["transition"] * 2}))


def test_hmm_infer_is_local_to_sequences(spark):
    df, m = frames(spark).drop("score", "label"), hmm.start()
    whole = {r.sample_id: r.p_state for r in hmm.infer(df, m).collect()}
    part = {r.sample_id: r.p_state for r in hmm.infer(df.filter("sequence_id = 's3'"), m).collect()}
    assert all(whole[k] == v for k, v in part.items())


def test_exit_steps_solve_the_system():
    m = hmm.start()
    t = hmm.exit_steps(m, [0, 1])
    assert t[:2] == pytest.approx(1 + m["transition"][:2, :2] @ t[:2]) and t[2] == 0
    closed = dict(m, transition=np.eye(4))
    with pytest.raises(ValueError):
        hmm.exit_steps(closed, [0])


def loop_policy(rows, confirm_steps=3, rescan_steps=1, cooldown=5):
    out, c, r, cool = [], 0, 0, 0
    for veto, ok, re_ok in rows:
        if veto:
            c = r = 0
            out.append("HOLD")
            cool = max(cool - 1, 0)
            continue
        c = c + 1 if ok else 0
        if ok and c >= confirm_steps:
            out.append("CONFIRM")
            cool, r = cooldown, 0
            continue
        r = r + 1 if re_ok else 0
        out.append("CONFIRM" if cool > 0 else "RESCAN" if re_ok and r >= rescan_steps else "HOLD")
        cool = max(cool - 1, 0)
    return out


def test_policy_fold_equals_a_loop(spark):
    df = frames(spark, 20, 40).withColumns({"veto": F.col("score") > 1.8, "confirm_ok": F.col("score") > -0.4, "rescan_ok": F.col("score") > -1.2})
    got = {r.sample_id: r.action for r in folds.policy(df).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.sequence_id, r.timestamp))
    for _, group in itertools.groupby(rows, key=lambda r: r.sequence_id):
        group = list(group)
        assert [got[r.sample_id] for r in group] == loop_policy([(r.veto, r.confirm_ok, r.rescan_ok) for r in group])


def test_filters_and_occupancy(spark):
    df = frames(spark)
    got = {r.sample_id: r.log_odds for r in folds.two_state_filter(df, 0.1).collect()}
    for _, g in itertools.groupby(sorted(df.collect(), key=lambda r: (r.sequence_id, r.timestamp)), key=lambda r: r.sequence_id):
        odds = 0.0
        for t, r in enumerate(g):
            if t:
                odds = np.logaddexp(np.log(0.1), np.log(0.9) + odds) - np.logaddexp(np.log(0.9), np.log(0.1) + odds)
            odds += r.score
            assert got[r.sample_id] == pytest.approx(odds)
    p = spark.range(1).select(folds.expected_occupancy(F.lit(0.8), 0.1, F.lit(7)).alias("x")).first().x
    assert p == pytest.approx(sum(0.5 + 0.3 * 0.8**j for j in range(1, 8)))


def test_alarm_events_with_persistence(spark):
    rows = [("a", float(t), f"{t}", act, "hazard" if t == 3 else "benign", p) for t, (act, p) in enumerate([("HOLD", None), ("RESCAN", 1.0), ("CONFIRM", 9.0), ("CONFIRM", float("nan")), ("HOLD", 0.0), ("RESCAN", float("nan")), ("RESCAN", None)])]
    df = spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, action string, label string, persistence_seconds double")
    a, b = events.alarm_events(df).orderBy("island").collect()
    assert (a.start_timestamp, a.end_timestamp, a.confirm_timestamp, a.clear_timestamp) == (1, 3, 2, 4)
    assert a.is_hazard and a.pred_confirmed and a.persistence_met_threshold and not a.is_flicker and a.event_score == 1
    assert b.clear_timestamp is None and b.confirm_timestamp is None and b.persistence_met_threshold is None and b.is_flicker
    rates = events.event_rates(events.alarm_events(df).filter("is_hazard")).first()
    assert rates.fcr == 0 and rates.mcr == 0
    assert events.event_rates(events.alarm_events(df).filter("is_hazard"), empty_fcr=None).first().fcr is None


def test_concordance_by_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.randrange(9)) for _ in range(150)]
    good = bad = tied = 0
    for (p, t), (q, u) in itertools.combinations(rows, 2):
        if t != u:
            x = (p - q) * (t - u)
            good, bad, tied = good + (x > 0), bad + (x < 0), tied + (x == 0)
    r = metrics.concordance(spark.createDataFrame(rows, "p int, t int"), "p", "t").first()
    assert (r.concordant, r.tied, r.comparable) == (good, tied, good + bad + tied)


def test_spectral_matrices():
    rng = np.random.default_rng(0)
    t = np.linspace(-1, 1, 41)
    cubic = 1 + t - 2 * t**2 + t**3
    assert spectra.savgol_matrix(41, 11, 3) @ cubic == pytest.approx(cubic)
    y = rng.normal(size=41)
    padded = np.pad(y, 2, mode="edge")
    assert spectra.moving_average_matrix(41, 5) @ y == pytest.approx(np.convolve(padded, np.ones(5) / 5, "valid"))
    inverse, design = spectra.poly_matrix(41, 2)
    assert inverse @ y == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0])
    spike = design @ np.array([1.0, 2.0, 3.0])
    spike[5] += 50
    assert spectra.huber_poly(spike[None], design)[0] == pytest.approx([1, 2, 3], abs=0.3)
    assert spectra.band(y[None], t, -1, 1, "integral")[0] == pytest.approx(np.trapezoid(y, t))


def test_indicators_are_row_local_and_finite(spark):
    df = simulate.simulate(spark, 4, 5)
    a = {r.sample_id: r.x for r in spectra.indicators(df).collect()}
    b = {r.sample_id: r.x for r in spectra.indicators(df.filter("timestamp = 2").repartition(2)).collect()}
    assert len(a) == 20 and all(a[k] == pytest.approx(v) for k, v in b.items())
    zero = np.zeros((2, 801))
    zero[1] = -1
    for c in (spectra.IndicatorConfig(), spectra.IndicatorConfig(normalization="unit_area", smoothing="moving_average", baseline="poly3", snr_mode="highfreq", noise_stat="std", band_stat="trimmed_mean", entropy_bins=16), spectra.IndicatorConfig(baseline="spline", band_stat="median"), spectra.IndicatorConfig(robust=True)):
        assert all(np.isfinite(v).all() for v in spectra.indicators_of(zero, simulate.grid(), c).values())


def test_simulation_does_not_depend_on_partitions(spark):
    a = sorted(map(str, simulate.simulate(spark, 5, 3, episodes=True).collect()))
    assert a == sorted(map(str, simulate.simulate(spark, 5, 3, episodes=True).repartition(1).collect()))


def test_cone_separates_and_refuses(spark):
    df = simulate.simulate(spark, 30, 4)
    rows = cone.cross_fit(df).join(df.select("sample_id", "label"), "sample_id").collect()
    y = np.array([r.label == "hazard" for r in rows], int)
    assert resample.auc(y, np.array([r.log_lr for r in rows])) > 0.9 and min(r.log_lr for r in rows) >= 0
    targets, shapes = cone.design(simulate.grid())
    assert cone.score_one(np.ones(801), targets, shapes, np.ones(801))[0] is None
    rng = np.random.default_rng(0)
    for _ in range(50):
        t, v = rng.normal(size=(9, 2)), rng.normal(size=9)
        rest, amounts = cone.cone_fit(t, v)
        grid = min(((v - t @ np.array([a, b])) ** 2).sum() for a in np.linspace(0, 3, 40) for b in np.linspace(0, 3, 40))
        assert (amounts >= 0).all() and rest <= grid + 1e-9


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(80)], "i int, v array<double>, y int")
    for metric in ("mahalanobis", "weighted_euclidean"):
        w = [1.0, 4.0, 0.25]
        state = regimes.fit_distance(df, "v", 3, F.col("y") == 1, w, metric)
        got = [r.d for r in df.withColumn("d", regimes.distance(F.col("v"), state)).orderBy("i").collect()]
        z = x * np.sqrt(w)
        gap = z - z[y == 1].mean(0)
        inv = np.linalg.pinv(np.cov(z[y == 1].T) + (1e-9 + 1e-6) * np.eye(3)) if metric == "mahalanobis" else np.eye(3)
        assert got == pytest.approx(np.sqrt(np.einsum("ni,ij,nj->n", gap, inv, gap)))


def test_transport():
    rng = np.random.default_rng(2)
    h, b = rng.normal(size=(30, 3)), rng.normal(size=(25, 3)) + 1
    cost = transport.squared_cost(h, b)
    assert cost == pytest.approx(((h[:, None] - b[None]) ** 2).sum(2))
    got = transport.potentials(h, b, 0.2)
    assert transport.marginal_error(cost, np.array(got["f"]), np.array(got["g"]), 0.2) <= 1e-6
    with pytest.raises(transport.TransportError):
        transport.sinkhorn_w2(cost, 1e-6)
    assert transport.gaussian_w2([0.0], np.array([[4.0]]), [3.0], np.array([[1.0]])) == pytest.approx(math.sqrt(10), abs=1e-3)
    two = transport.sinkhorn_w2(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.01)
    assert two == pytest.approx(0, abs=1e-6)
    state = transport.fit_coordinate(h, b, 0.3)
    assert transport.coordinate_of(state, h).mean() > transport.coordinate_of(state, b).mean()
    flat = transport.fit_coordinate(h, b, None)
    q = rng.normal(size=(5, 3))
    want = ((q[:, None] - b[None]) ** 2).sum(2).mean(1) - ((q[:, None] - h[None]) ** 2).sum(2).mean(1)
    assert np.diff(transport.coordinate_of(flat, q)) == pytest.approx(np.diff(want))


def test_embedding_gradient_and_apply(spark):
    rng = np.random.default_rng(3)
    x, y, risk = rng.normal(size=(12, 5)), np.arange(12) % 3, rng.uniform(size=12)
    for metric in (embed.triplet, embed.contrastive):
        w = embed.init(5, 3, 3, 0)
        _, g = embed.loss_and_gradient(w, x, y, risk, metric)
        for k in ("W0", "b1", "W2", "Wc", "Wr"):
            i = tuple(0 for _ in w[k].shape)
            up, down = ({n: a.copy() for n, a in w.items()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            slope = (embed.loss_and_gradient(up, x, y, risk, metric)[0] - embed.loss_and_gradient(down, x, y, risk, metric)[0]) / 2e-6
            assert g[k][i] == pytest.approx(slope, abs=1e-5)
    rows = [(f"{i:04d}", (rng.normal(size=4) + 3 * (i % 2)).tolist(), i % 2, float(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, x array<double>, y int, risk double")
    state = embed.fit(df, "x", "y", "risk", F.col("sample_id") < "0080", epochs=6)
    assert state["history"][-1] < state["history"][0] + 1e-9
    z = {r.sample_id: r.z for r in embed.apply(df, "x", state, ["sample_id"]).collect()}
    part = {r.sample_id: r.z for r in embed.apply(df.filter("sample_id > '0100'"), "x", state, ["sample_id"]).collect()}
    assert all(z[k] == pytest.approx(v) for k, v in part.items()) and np.linalg.norm(z["0000"]) == pytest.approx(1)


def test_many_sequences_are_each_alone(spark, monkeypatch):
    """Recursions over sequences side by side give what each gives by itself, whatever the chunks; and a step of EM is
    one over single frames."""
    rng = np.random.default_rng(8)
    m = hmm.start()
    m["mean"], m["var"] = rng.normal(size=(4, 2)), np.ones((4, 2))
    rows, by = [], {}
    for i, n in enumerate([1, 7, 3, 12, 7, 1, 30]):
        obs, z = rng.integers(0, 4, n), rng.normal(size=(n, 2))
        by[f"s{i}"] = obs, z
        rows += [(f"s{i}", float(t), f"s{i}_{t:03d}", int(obs[t]), z[t].tolist()) for t in range(n)]
    df = spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, obs int, z array<double>").repartition(3)
    want = {k: hmm.smoothed(hmm.log_emission(m, *v), m) for k, v in by.items()}
    ahead = {k: np.exp(hmm.filtered(hmm.log_emission(m, *v), m)[0]) for k, v in by.items()}
    for chunk in (500_000, 5):
        monkeypatch.setattr(hmm, "CHUNK", chunk)
        for smoothing, told in ((False, ahead), (True, {k: v[0] for k, v in want.items()})):
            for r in hmm.infer(df, m, smoothing).collect():
                assert r.p_state == pytest.approx(told[r.sequence_id][int(r.timestamp)])
        stats = hmm._statistics(hmm.sequences(df), m)
        assert stats["ll"] == pytest.approx(sum(v[2] for v in want.values()))
        assert stats["moves"] == pytest.approx(sum(v[1] for v in want.values()))
        assert stats["first"] == pytest.approx(sum(v[0][0] for v in want.values()))
        assert stats["sum"] == pytest.approx(sum(v[0].T @ by[k][1] for k, v in want.items()))
        seen = np.zeros((4, 4))
        for k, v in want.items():
            for t, o in enumerate(by[k][0]):
                seen[:, o] += v[0][t]
        assert stats["seen"] == pytest.approx(seen)


def test_resampling(spark):
    assert resample.exact_interval(0, 189) == pytest.approx((0, 0.01933), abs=1e-4)
    assert resample.exact_interval(1, 98) == pytest.approx((0.000258, 0.0555), abs=1e-4)
    low, high = resample.exact_interval(5, 20)
    tail = sum(math.comb(20, k) * low**k * (1 - low) ** (20 - k) for k in range(5, 21))
    assert tail == pytest.approx(0.025, abs=1e-6) and high > 0.25
    df = spark.createDataFrame([(f"{i:02d}", float(i)) for i in range(30)], "sequence_id string, v double")
    r = resample.bootstrap_mean(df, "sequence_id", "v", 50, 1).first()
    draw = lambda r, j: int(hashlib.md5(f"1:{r}:{j}".encode()).hexdigest()[:15], 16) % 30
    means = [np.mean([draw(r, j) for j in range(30)]) for r in range(50)]
    assert (r.mean, r.low, r.high) == pytest.approx((14.5, *np.percentile(means, [2.5, 97.5])))
    y, s = np.array([1, 0, 1, 0, 0]), np.array([0.9, 0.9, 0.4, 0.1, 0.4])
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert resample.auc(y, s) == pytest.approx(np.mean(pairs))


def test_densities_and_tensors(spark):
    rng = np.random.default_rng(4)
    f = [np.abs(rng.normal(size=(n, 2))) for n in (6, 5, 9)]
    cube = np.einsum("ir,jr,kr->ijk", *f)
    assert tensor.cp_als(cube, 2, restarts=5)[1] < 1e-3
    basis = tensor.blank_basis(rng.normal(size=(20, 9)), 3)
    left = tensor.net_analyte(rng.normal(size=9), basis)
    assert basis @ left == pytest.approx(np.zeros(3), abs=1e-12)
    seqs = [np.concatenate([rng.normal(size=(6, 2)), rng.normal(size=(6, 2)) + 4]) for _ in range(8)]
    m = density.fit_chain(seqs, 0, hidden=True)
    assert sorted(m["mean"][:, 0].round()) == [0.0, 4.0]
    x = np.concatenate([rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 5])
    df = spark.createDataFrame([(i, x[i].tolist(), i // 20) for i in range(40)], "k int, v array<double>, y int")
    got = {r.k: r.silhouette for r in density.silhouette(df, "k", "v", "y").collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    a, b = d[3, :20].sum() / 19, d[3, 20:].mean()
    assert got[3] == pytest.approx((b - a) / max(a, b))
    light, w, c, error = tensor.joint_unmix(np.abs(rng.normal(size=(10, 2))) @ np.abs(rng.normal(size=(2, 12))), 2)
    assert error < 0.1
    flat, gain = tensor.self_calibrate(np.exp(np.linspace(-1, 1, 30))[None] * np.ones((4, 1)))
    assert flat == pytest.approx(np.ones((4, 30)), abs=1e-6)


def test_silhouette_of_any_number_of_points(spark, monkeypatch):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 300)
    x = np.concatenate([rng.normal(size=(300, 3)) + y[:, None], np.ones((3, 3)), [[9.0, 9, 9]]])
    y = np.concatenate([y, [1, 1, 1, 7]])
    k = [*range(300), 300, 300, 300, 301]
    df = spark.createDataFrame([(k[i], x[i].tolist(), int(y[i])) for i in range(304)], "k int, v array<double>, y int").repartition(3)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(304):
        a = d[i, y == y[i]].sum() / max((y == y[i]).sum() - 1, 1)
        b = min(d[i, y == m].mean() for m in set(y.tolist()) - {y[i]})
        want.append((k[i], (b - a) / max(a, b) if (y == y[i]).sum() > 1 else 0.0))
    for cloud in (20_000, 304, 100, 38):
        monkeypatch.setattr(density, "CLOUD", cloud)
        got = sorted((r.k, r.silhouette) for r in density.silhouette(df, "k", "v", "y").collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert density.silhouette(df.limit(0), "k", "v", "y").collect() == []


def test_silhouette_above_one_block(spark):
    """More points than one block holds, at the size that is shipped: four places, so distances are known."""
    place = F.pmod("id", F.lit(4))
    df = spark.range(20_400).select("id", F.array((place / 2).cast("int").cast("double"), F.pmod(place, F.lit(2)) * 9.0).alias("v"), F.pmod(place, F.lit(2)).alias("y"))
    out = density.silhouette(df, "id", "v", "y").agg(F.count("*"), F.min("silhouette"), F.max("silhouette")).first()
    a, b = 10_200 / 2 / (10_200 - 1), (9 + 82**0.5) / 2
    assert out[0] == 20_400 and out[1:] == pytest.approx([(b - a) / b] * 2, abs=1e-6)


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "v double")
    assert {r.v: r.avg_rank for r in windows.average_ranks(df, "v").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_spectra_are_worked_off_in_slices(spark):
    from tidemark.sources import frames, simulate

    df = spark.range(1, 1002, 1, 1).selectExpr("cast(id AS string) AS name", "IF(id % 2 = 0, null, id / 2) AS x", "array(cast(id AS double)) AS v")

    def sizes(batches):
        for b in batches:
            yield b.assign(n=len(b))

    rows = frames.map_slices(df, sizes, "name string, x double, v array<double>, n int").collect()
    assert [(r.name, r.x, r.v) for r in rows] == [tuple(r) for r in df.collect()] and max(r.n for r in rows) <= frames.SLICE
    out = simulate.simulate(spark, 60).coalesce(1)
    assert out.count() == 600 and "MapInArrow" in out._jdf.queryExecution().toString()
