"""Fits and small writers against brute force or invariants."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import density, hmm, resample, spectra, transport
from tidemark.plans import config
from tidemark.sources import simulate, sinks


def brute_em(rows, m, band):
    """One step of EM by summing over all paths of states."""
    import itertools

    n = len(m["initial"])
    first, moves, seen, ll = np.zeros(n), np.zeros((n, n)), np.zeros((n, n)), 0.0
    for obs in rows:
        total, own = 0.0, [np.zeros(n), np.zeros((n, n)), np.zeros((n, n))]
        for path in itertools.product(range(n), repeat=len(obs)):
            p = m["initial"][path[0]] * m["emission"][path[0], obs[0]]
            for a, b, o in zip(path, path[1:], obs[1:]):
                p *= max(m["transition"][a, b], hmm.EPS) * m["emission"][b, o]
            total += p
            own[0][path[0]] += p
            for a, b in zip(path, path[1:]):
                own[1][a, b] += p
            for a, o in zip(path, obs):
                own[2][a, o] += p
        first, moves, seen, ll = first + own[0] / total, moves + own[1] / total, seen + own[2] / total, ll + math.log(total)
    inside = np.abs(np.arange(n)[:, None] - np.arange(n)) <= band
    norm = lambda x: x / x.sum(1, keepdims=True)
    return {"initial": first / first.sum(), "transition": norm(np.where(inside, moves + hmm.dirichlet(n), 0)), "emission": norm(seen + hmm.start(n)["emission"])}, ll


def test_a_step_of_em_equals_all_paths(spark):
    rng = np.random.default_rng(3)
    obs = [rng.integers(0, 4, n) for n in (1, 4, 3, 5, 5)]
    rows = [(f"s{i}", float(t), f"{t}", int(o)) for i, s in enumerate(obs) for t, o in enumerate(s)]
    model, history = hmm.fit(spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, obs int"), iterations=1)
    m = hmm.start()
    m["initial"] = np.bincount([s[0] for s in obs], minlength=4) / len(obs)
    m["initial"] = np.clip(m["initial"], hmm.EPS, None)
    want, _ = brute_em(obs, m, 1)
    for k, v in want.items():
        np.testing.assert_allclose(model[k], v, atol=1e-9)
    _, ll = brute_em(obs, {k: np.clip(v, hmm.EPS, None) for k, v in want.items()}, 1)
    assert history[0] == pytest.approx(ll)


def test_likelihood_rises(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i}", float(t), f"{t:03d}", int(o)) for i in range(20) for t, o in enumerate(np.repeat(rng.integers(0, 4, 5), 6))]
    _, history = hmm.fit(spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, obs int"), iterations=8)
    assert all(b > a - 0.5 for a, b in zip(history, history[1:])) and history[-1] > history[0]


def test_whitened_filter(spark):
    rng = np.random.default_rng(1)
    x, template = rng.normal(size=(40, 6)) @ np.diag([1, 2, 3, 1, 1, 5]), rng.normal(size=6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample_id int, spectrum array<double>").repartition(3)
    state = spectra.whitened_filter(df, template, 0.1)
    cov = np.cov(x.T)
    cov = 0.9 * cov + (0.1 * np.trace(cov) / 6 + 1e-12) * np.eye(6)
    w = np.linalg.solve(cov, template)
    want = (x - x.mean(0)) @ w / np.sqrt(template @ w)
    got = {r.sample_id: r.filter_score for r in spectra.apply_filter(df, state).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(want)


def test_logistic_is_at_its_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, v array<double>, y double")
    model = density.logistic(df, "v", "y", 2.0)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / 200 + w / 400).max() < 1e-4 and abs((p - y).mean()) < 1e-4
    got = {r.i: r.score for r in density.logistic_scores(df, "v", model, ["i"]).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(p)


def test_discriminant_projection():
    rng = np.random.default_rng(4)
    h, b = rng.normal(size=(60, 5)), rng.normal(size=(50, 5))
    h[:, 2] += 6
    fit = transport.fit_discriminant(h, b, 1, steps=60, rate=0.1)
    p = np.array(fit["projection"])
    assert p.T @ p == pytest.approx(np.eye(1)) and abs(p[2, 0]) > 0.9 and fit["value"] > fit["history"][0]
    assert fit["value"] == pytest.approx(transport.discriminant_ratio(p, h, b))


def test_stratified_draws(spark):
    rng = np.random.default_rng(6)
    y = rng.random(80) < 0.4
    a, b = rng.normal(size=80), y + rng.normal(size=80)
    df = spark.createDataFrame([(f"{i:02d}", bool(y[i]), float(a[i]), float(b[i])) for i in range(80)], "id string, y boolean, a double, b double").repartition(3)
    out = {r.arm: r for r in resample.stratified_auc(df, "id", F.col("y"), ["a", "b"], 60, (1, 2)).collect()}
    sides = [np.flatnonzero(y), np.flatnonzero(~y)]
    areas = []
    for r in range(60):
        own = np.concatenate([side[[int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:15], 16) % len(side) for j in range(len(side))]] for seed, side in zip((1, 2), sides)])
        areas.append([resample.auc(y[own].astype(int), s[own]) for s in (a, b)])
    areas = np.array(areas)
    for arm, v in (("a", areas[:, 0]), ("b", areas[:, 1]), ("b-a", areas[:, 1] - areas[:, 0])):
        assert (out[arm].mean, out[arm].low, out[arm].high, out[arm].n_finite) == pytest.approx((v.mean(), *np.percentile(v, [2.5, 97.5]), 60))


def test_densities_of_tables_equal_those_of_lists(spark):
    rng = np.random.default_rng(9)
    seqs = [np.concatenate([rng.normal(size=(5, 2)), rng.normal(size=(int(n), 2)) + 4]) for n in rng.integers(2, 9, 12)]
    rows = [(f"s{i}", float(t), f"s{i}_{t}", z.tolist()) for i, s in enumerate(seqs) for t, z in enumerate(s)]
    df = spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, z array<double>").repartition(4)
    for hidden in (True, False):
        a, b = density.fit_chain(seqs, 0, hidden), density.fit_frames(df, 0, hidden)
        order = [np.argsort(m["mean"][:, 0]) for m in (a, b)]
        for k in ("mean", "var"):
            np.testing.assert_allclose(a[k][order[0]], b[k][order[1]], rtol=1e-3)
    got = {(r.sequence_id, r.arm): r.llr for r in density.chain_likelihood(df, {"x": (a, b), "y": (density.fit_chain(seqs[:3], 1, True), a)}).collect()}
    other = density.fit_chain(seqs[:3], 1, True)
    for i, s in enumerate(seqs):
        ll = [hmm.filtered(hmm.log_emission(m, np.zeros(len(s)), s), m)[1].sum() for m in (other, a)]
        assert got[f"s{i}", "y"] == pytest.approx((ll[0] - ll[1]) / len(s)) and len(got) == 2 * len(seqs)


def test_latents_follow_their_priors(spark):
    from tidemark.sources import latents

    ids = spark.range(4000).select(F.col("id").cast("string").alias("sequence_id"))
    key = F.col("sequence_id")
    x = ids.select(*[latents.drawn(latents.PRIORS[n], key, n, 3).alias(n) for n in ("path", "concentration", "tilt")], latents.drawn({"prior": "normal", "mean": 0, "std": 1, "min": -0.5, "max": 0.5}, key, "z", 3).alias("z")).toPandas()
    assert x["path"].between(0.8, 1.2).all() and x["path"].mean() == pytest.approx(1.0, abs=0.01)
    assert x["concentration"].between(0.1, 1).all() and np.log10(x["concentration"]).mean() == pytest.approx(-0.5, abs=0.02)
    assert x["tilt"].mean() == pytest.approx(0, abs=3e-4) and x["tilt"].std() == pytest.approx(0.005, rel=0.05) and x["z"].min() == -0.5 and x["z"].max() == 0.5
    mixes = [r.m for r in ids.select(latents.mixed(key, ["a", "b", "c"], 2, 3, 3).alias("m")).collect()]
    assert all(2 <= len(m) <= 3 and sum(m.values()) == pytest.approx(1) for m in mixes)
    assert sum(len(m) == 2 for m in mixes) / 4000 == pytest.approx(0.5, abs=0.03) and sum("a" in m for m in mixes) / 4000 == pytest.approx(5 / 6, abs=0.03)
    onset, duration = latents.episode(key, 10, 3)
    e = ids.select(onset.alias("o"), duration.alias("d")).toPandas()
    assert set(e["o"]) == set(range(1, 7)) and e["d"].min() == 3 and (e["o"] + e["d"]).max() == 10
    own = latents.frames_of(ids.limit(50), 4, 3, independent=True).select("sequence_id", "latents.path").groupBy("sequence_id").agg(F.count_distinct("path").alias("n")).collect()
    assert all(r.n == 4 for r in own)
    held = latents.frames_of(ids.limit(50), 4, 3).groupBy("sequence_id").agg(F.count_distinct("latents.path").alias("n"), (F.max("latents.dust") - F.min("latents.dust")).alias("d")).collect()
    assert all(r.n == 1 and r.d == pytest.approx(0.03) for r in held)
    with pytest.raises(ValueError):
        latents.drawn({"prior": "other"}, key, "x", 3)


def test_noise_and_clipping():
    clean = np.full(20_000, 0.3)
    noisy, share = simulate.add_noise(clean, 0.02, 0.01, np.random.default_rng(0))
    assert share == 0 and noisy.mean() == pytest.approx(0.3, abs=0.005) and noisy.std() == pytest.approx(math.sqrt(0.02**2 + 0.01 * 0.3), rel=0.02)
    clipped, share = simulate.add_noise(np.zeros(1000), 0.1, 0.0, np.random.default_rng(0))
    assert clipped.min() == 0 and share == pytest.approx((clipped == 0).mean())


def test_small_writers(tmp_path):
    sinks.append_line(tmp_path / "log.jsonl", {"b": 1, "a": float("nan")})
    sinks.append_line(tmp_path / "log.jsonl", {"a": np.float64(2.5), "b": np.arange(2)})
    assert (tmp_path / "log.jsonl").read_text() == '{"a":null,"b":1}\n{"a":2.5,"b":[0,1]}\n'
    (tmp_path / "x.txt").write_text("x")
    made = sinks.manifest(tmp_path / "m.json", {"k": 1}, {"in": "h"}, {"x": tmp_path / "x.txt"})
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", made["created"]) and json.loads((tmp_path / "m.json").read_text()) == made
    trace: list = []
    rng = np.random.default_rng(0)
    transport.potentials(rng.normal(size=(12, 2)), rng.normal(size=(9, 2)) + 1, 0.5, trace=trace)
    assert [t["step"] for t in trace] == list(range(len(trace))) and trace[-1]["marginal_l1"] <= 1e-6
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert config.read(tmp_path / "c.json") == {"a": {"b": 1}}


def test_scratch_needs_a_shared_folder(spark):
    from tidemark.sources.frames import scratch

    a, b = scratch(spark, "x"), scratch(spark, "x")
    assert a != b and a.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_timed_alarm_events(spark, tmp_path):
    """An open event is closed by the clock once another sequence's frames have moved the watermark past it."""
    from tidemark.streaming import stateful

    shape = "sequence_id string, timestamp double, sample_id string, action string, score double"
    files = [
        [("a", 1.0, "a1", "RESCAN", 0.2), ("a", 2.0, "a2", "CONFIRM", 0.9), ("b", 1.0, "b1", "CONFIRM", 0.5)],
        [("b", 3.0, "b2", "HOLD", 0.1), ("c", 1000.0, "c1", "HOLD", 0.0)],
        [("c", 2000.0, "c2", "CONFIRM", 0.7)],
        [("c", 2001.0, "c3", "HOLD", 0.0)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = {(r.start_sample_id, r.end_sample_id, r.confirm_timestamp, r.max_score, r.closed_by) for r in stateful.to_table(stateful.alarm_events(stream, 60.0)).collect()}
    assert out == {("a1", "a2", 2.0, 0.9, "silence"), ("b1", "b1", 1.0, 0.5, "hold"), ("c2", "c2", 2000.0, 0.7, "hold")}


def test_both_sides_and_arms_are_fitted_in_one_pass_a_step(spark, monkeypatch):
    rng, passes = np.random.default_rng(5), []
    seqs = [np.concatenate([rng.normal(s, 0.5, (10, 2)), rng.normal(s + 3, 0.5, (10, 2))]) for s in (0, 0, 1, 1, 1)]
    rows = [(int(s > 1), f"q{s}", float(t), f"{s}-{t}", seqs[s][t].tolist()) for s in range(5) for t in range(20)]
    df = spark.createDataFrame(rows, "side int, sequence_id string, timestamp double, sample_id string, z array<double>")
    step = density._step_sums
    monkeypatch.setattr(density, "_step_sums", lambda *a: passes.append(1) or step(*a))
    found = density.fit_sides(df, 0, {"mixture": False, "chain": True})
    assert len(passes) <= 50
    for (arm, side), a in found.items():
        b = density.fit_chain([s for k, s in enumerate(seqs) if int(k > 1) == side], 0, arm == "chain")
        i, j = np.argsort(a["mean"][:, 0]), np.argsort(b["mean"][:, 0])
        np.testing.assert_allclose(a["mean"][i], b["mean"][j], atol=1e-4)
        np.testing.assert_allclose(a["var"][i], b["var"][j], atol=1e-4)
        np.testing.assert_allclose(a["initial"][i], b["initial"][j], atol=1e-4)


def test_bootstrap_of_a_mean_does_not_send_its_draws(spark, monkeypatch):
    rows = [(f"u{i % 90:03d}", float(i % 7)) for i in range(130)] + [(None, 5.0), ("u000", None)]
    df = spark.createDataFrame(rows, "id string, v double").repartition(3)
    drawn = resample.multiplicities(df, "id", 40, 3).join(df, "id").groupBy("replicate").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("m"))
    want = np.percentile([r.m for r in drawn.collect()], [2.5, 97.5])
    for block in (1 << 22, 32):
        monkeypatch.setattr(resample, "BLOCK", block)
        out = resample.bootstrap_mean(df, "id", "v", 40, 3)
        r = out.first()
        assert (r.low, r.high, r.replicates) == (pytest.approx(want[0]), pytest.approx(want[1]), 40)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [replicate" in plan and ", position" not in "".join(x for x in plan.splitlines() if "Aggregate [" in x)
    assert resample.bootstrap_mean(df.limit(0), "id", "v", 40, 3).first().replicates == 0


def test_areas_of_replicates_move_no_row_for_each_score(spark, monkeypatch):
    """Rows are ordered once: replicates send packed counts, and stripes with ties, nulls and cuts give the same areas."""
    monkeypatch.setattr(resample, "ROWS", 40)
    monkeypatch.setattr(resample, "PACK", 7)
    monkeypatch.setattr(resample, "COUNTED", 16)
    rng = np.random.default_rng(8)
    n, of = 600, rng.integers(0, 30, 600)
    s, y = np.round(rng.normal(size=n), 1) + 0.3 * (of % 2), rng.random(n) < 0.3
    s[:150], high = 0.5, rng.random(n) < 0.05
    df = spark.createDataFrame([(f"s{u:02d}", None if h else float(x), bool(t)) for u, x, t, h in zip(of, s, y, high)], "sequence_id string, score double, y boolean")
    got = resample.cluster_auc(df, "score", F.col("y"), 50, 3).first()
    x = np.where(high, np.inf, s)  # SQL has nulls last
    areas = []
    for r in range(50):
        k = np.bincount([int(hashlib.md5(f"3:{r}:{j}".encode()).hexdigest()[:15], 16) % 30 for j in range(30)], minlength=30)
        areas.append(resample.auc(np.repeat(y, k[of]).astype(int), np.repeat(x, k[of])))
    assert (got.mean, got.low, got.high, got.n_finite) == pytest.approx((np.mean(areas), *np.percentile(areas, [2.5, 97.5]), 50))
    assert resample.cluster_auc(df.limit(0), "score", F.col("y"), 50, 3).first().n_finite == 0


def test_packed_draws_are_a_row_for_each_replicate(spark):
    rows = resample.packed_draws(spark, 300, 40, 5, base=2).collect()
    whole = np.zeros((40, 300), int)
    for r in rows:
        whole[r.replicate, r.start - 2 : r.start - 2 + r.n] += np.frombuffer(r.k, f"<u{len(r.k) // r.n}")
    want = [[int(hashlib.md5(f"5:{r}:{j}".encode()).hexdigest()[:15], 16) % 300 for j in range(300)] for r in range(40)]
    assert (whole == [np.bincount(w, minlength=300) for w in want]).all() and len(rows) < 80


def test_draws_of_a_mean_are_made_in_steps(spark, monkeypatch):
    """The same draws as one by one, whatever the length of their numbers and of a step; Spark takes no digest of each."""
    monkeypatch.setattr(resample, "STEP", 300)
    want = {(r.replicate, r.position): r.n for r in resample.draws_of(spark, 1234, 12, 7).groupBy("replicate", "position").agg(F.count("*").alias("n")).collect()}
    got = {}
    for replicate, at in resample.draws_in_steps(1234, list(range(12)), 7):
        for x in at.tolist():
            got[replicate, x] = got.get((replicate, x), 0) + 1
    assert got == want
    df = spark.createDataFrame([(f"u{i}", i / 7 - 2) for i in range(60)] + [("none", None), (None, 1.5)], "id string, v double")
    out = resample.bootstrap_mean(df, "id", "v", 30, 3)
    drawn = resample.multiplicities(df, "id", 30, 3).join(df, "id").groupBy("replicate").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("m"))
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert (r.low, r.high) == pytest.approx(tuple(np.percentile([x.m for x in drawn.collect()], [2.5, 97.5])), abs=1e-12)
    assert r["mean"] == pytest.approx(df.agg(F.avg("v")).first()[0], abs=1e-12)
