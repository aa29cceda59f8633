"""Experiments, audits and the command line."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tidemark.__main__ import main
from tidemark.operators import hmm
from tidemark.plans import audit, experiment
from tidemark.sources import simulate
from tidemark.sources.frames import event_frames


def test_arms_acceptance_and_deltas(spark):
    frames = experiment.with_regimes(event_frames(spark, SMALL)).cache()
    rows = experiment.run_arms(frames, experiment.baselines()).cache()
    assert rows.select("method").distinct().count() == 4
    assert rows.filter("fcr < 0 OR fcr > 1 OR mcr < 0 OR mcr > 1 OR toggle_rate < 0").count() == 0
    split = [r.split for r in rows.select("split").distinct().collect()][0]
    status = {r.criterion: (r.value, r.status) for r in experiment.acceptance(rows, "B2", split).collect()}
    by = {r.method: r for r in rows.filter(F.col("split") == split).collect()}
    cut = by["B0"].toggle_rate
    want = (1.0 if by["B2"].toggle_rate == 0 else 0.0) if cut == 0 else (cut - by["B2"].toggle_rate) / cut
    assert status["toggle_reduction_vs_b0"][0] == pytest.approx(want)
    alone = {r.criterion: r.status for r in experiment.acceptance(rows.filter("method = 'B2'"), "B2", split).collect()}
    assert alone["toggle_reduction_vs_b0"] == alone["mcr_delta_bound"] == "unevaluable"
    assert experiment.deltas(rows, "B0").count() == rows.filter("method <> 'B0'").count()
    assert experiment.attribution(experiment.acceptance(rows, "B2", split)).filter("status = 'pass'").count() == 0


def test_runs_and_frozen_settings(spark, tmp_path):
    rows = spark.createDataFrame([("B0", 0.5)], "method string, fcr double")
    path = f"file://{tmp_path}/run"
    experiment.save_run(path, {"a": 1}, "test", {"metrics": rows})
    assert experiment.reload_run(spark, path, {"a": 1}, "test")["metrics"].collect() == rows.collect()
    for config, split in (({"a": 2}, "test"), ({"a": 1}, "val")):
        with pytest.raises(ValueError):
            experiment.reload_run(spark, path, config, split)
    frozen = {"states": ["a", "b"], "confirmable": ["a"], "ordering": ["a", "b"], "observations": "hybrid", "field": "z", "dt_seconds": 1.0, "include_smoothing": False}
    hmm.check_runtime(frozen, frozen)
    hmm.check_runtime({**frozen, "observations": "discrete", "field": "x"}, {**frozen, "observations": "discrete"})
    for change in ({"states": ["b", "a"]}, {"field": "x"}, {"dt_seconds": 2.0}, {"include_smoothing": True}):
        with pytest.raises(ValueError):
            hmm.check_runtime({**frozen, **change}, frozen)
    for wrong in ({**frozen, "dt_seconds": True}, {**frozen, "dt_seconds": -1.0}, {**frozen, "include_smoothing": 0}, {k: v for k, v in frozen.items() if k != "field"}):
        with pytest.raises(ValueError):
            hmm.check_runtime(wrong, wrong)
    hmm.check_inputs("discrete", "z", None, None)
    hmm.check_inputs("hybrid", "x", None, "there")
    for field in "zx":
        with pytest.raises(ValueError):
            hmm.check_inputs("continuous", field, None, None)


def test_rules(spark):
    stress = spark.createDataFrame([(0.1, "a", 0.0, 0.0), (0.2, "b", 0.03, -0.1), (0.3, "c", 0.02, 0.0)], "severity double, name string, delta_fcr double, delta_mcr double")
    got = {r.metric: (r.value, r.status) for r in experiment.graceful(stress, {"delta_fcr": 0.02, "delta_mcr": 0.2}).collect()}
    assert got["delta_fcr"] == (pytest.approx(0.03), "fail") and got["delta_mcr"] == (pytest.approx(0.1), "pass")
    assert {r.status for r in experiment.graceful(stress.limit(1), {"delta_fcr": 1.0}).collect()} == {"unevaluable"}
    bins = spark.createDataFrame([(0.1, 1.0), (0.2, 2.0), (0.3, 1.5)], "pred_mean double, target_mean double")
    assert experiment.monotonicity(bins).first().status == "fail" and experiment.monotonicity(bins.limit(1)).first().status == "unevaluable"
    c = [("a", True, False, 0.1, 0.2, 0.3, 5, 0), ("b", True, False, 0.1, 0.2, 0.3, 2, 1), ("c", False, False, 0.0, 0.0, 0.0, 1, 2), ("d", True, True, 0.0, 0.0, 0.0, 1, 3)]
    ranked = experiment.select_candidate(spark.createDataFrame(c, "name string, acceptable boolean, failed boolean, fcr double, mcr double, toggle_rate double, simplicity int, position int")).orderBy("place").collect()
    assert [r.name for r in ranked] == ["b", "a", "c", "d"] and [r.selected for r in ranked] == [True, False, False, False]
    rows = [("v", "r", s, -0.1, -0.2, -0.01, -0.1) for s in (1, 2)] + [("v", "r", 3, -0.1, -0.3, 0.1, -0.2)] + [("w", "r", s, -0.1, -0.2, -0.01, 0.1) for s in (1, 2, 3)] + [("x", "r", 1, -0.1, -0.2, -0.01, None)]
    rules = experiment.decision_rule(spark.createDataFrame(rows, "arm string, reference string, seed int, fcr double, fcr_low double, fcr_high double, mcr_low double"), [1, 2, 3])
    assert {r.arm: r.useful for r in experiment.useful_arms(rules).collect()} == {"v": True, "w": False, "x": False}
    assert experiment.zero_failure_floor(0.01) == 299 and experiment.quality_gates({"a": 3, "b": None}, {"a": 5, "b": 1}) == {"a": "fail", "b": "unevaluable"}
    assert experiment.progression((0, 200), {"A|decade=-2": (19, 20)}, 120) == "FAVORABLE"
    assert experiment.progression((30, 200), {"A|decade=-2": (19, 20)}, 120) == "UNFAVORABLE"
    assert experiment.progression((0, 200), {"A|decade=-2": (0, 40)}, 120) == "UNFAVORABLE"
    assert experiment.progression((0, 200), {"A|decade=-2": (5, 20)}, 50) == "UNEVALUABLE"
    draws = spark.createDataFrame([(float(i),) for i in range(101)] + [(math.nan,), (None,)], "v double")
    assert tuple(experiment.finite_interval(draws, "v").first()) == (2.5, 97.5, 101)


def test_audits(spark):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        y, d = i % 2 == 0, rng.random()
        rows.append((f"{i:04d}", "a" if i < 300 else "b", y, d, rng.gauss(3 * d if y else 0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "sample_id string, scenario_id string, y boolean, d double, good double, noise double")
    got = {(r.scenario_id, r.probe): r for r in audit.probes(df, ["good", "noise"], F.col("y")).collect()}
    assert len(got) == 6 and got["pooled", "good"].auc > 0.75 and abs(got["pooled", "noise"].auc - 0.5) < 0.1
    bins = audit.detectability_bins(df, "d", "good", F.col("y"), 4, 0.8).orderBy("bin").collect()
    assert [b.auc for b in bins] == sorted(b.auc for b in bins) and bins[-1].passes and not bins[0].passes
    assert audit.trend(audit.detectability_bins(df, "d", "good", F.col("y"), 4, 0.8)).first().tracks_detectability
    levels = audit.envelope(df, "d", "good", F.col("y"), [0.0, 0.3, 0.6], 0.8).orderBy("level").collect()
    assert [r.n_pos for r in levels] == [sum(r[2] and r[3] >= v for r in rows) for v in (0.0, 0.3, 0.6)]
    assert audit.lowest_passing(audit.envelope(df, "d", "good", F.col("y"), [0.0, 0.6], 0.8)).first().level in (0.0, 0.6)
    base = dict(n_mismatch=0, underpowered=False, ceiling_auc=0.9, ceiling_low=0.85, ceiling_high=0.95, raw_auc=0.9, raw_low=0.8, tracks=True, only_highest_pass=False)
    cases = {
        "label_provenance_bug": {"n_mismatch": 1}, "underpowered_inconclusive": {"underpowered": True}, "ceiling_invalid": {"ceiling_auc": 0.3}, "both_present": {},
        "indicator_information_loss": {"raw_auc": 0.6}, "generative_subnoise": {"ceiling_auc": 0.6, "ceiling_low": 0.55, "only_highest_pass": True},
        "no_grounded_separability_confound": {"ceiling_auc": 0.51, "ceiling_low": 0.4, "ceiling_high": 0.6, "tracks": False}, "inconclusive": {"ceiling_auc": 0.7, "ceiling_low": 0.6},
    }
    shape = "n_mismatch int, underpowered boolean, ceiling_auc double, ceiling_low double, ceiling_high double, raw_auc double, raw_low double, tracks boolean, only_highest_pass boolean"
    for want, change in cases.items():
        row = base | change
        assert audit.verdict(spark.createDataFrame([tuple(row.values())], shape)).first().verdict == want


def test_integrity_and_truth(spark):
    df = simulate.simulate(spark, 8, 4, episodes=True)
    mix = F.from_json("mixture_json", "struct<components: array<string>>")["components"]
    assert audit.label_integrity(df, mix, list(simulate.HAZARDS), F.col("label")).first().n_mismatch == 0
    wrong = audit.label_integrity(df, mix, list(simulate.HAZARDS), F.lit("hazard")).first()
    assert wrong.n_mismatch == df.filter("label = 'benign'").count() and len(wrong.examples) <= 5
    truth = audit.ground_truth(df, F.col("latent_json"), F.col("mixture_json"), list(simulate.HAZARDS))
    assert truth.count() == 8 and all(r.n_frames == 4 for r in truth.collect())
    assert audit.frontier(truth, F.col("concentration") > 0).filter("identity IS NULL AND decade IS NULL").first().n == 8


def test_command_line_chain(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "c.yaml").write_text("sequences: 60\nframes: 5\n")
    (tmp_path / "e.json").write_text('{"epochs": 1}')
    main(["simulate", "--out", p("spectra.parquet"), "--config", p("c.yaml")], spark)
    main(["indicators", "--in", p("spectra.parquet"), "--out", p("ind.parquet")], spark)
    main(["regimes", "--in", p("ind.parquet"), "--out", p("reg.parquet"), "--model", p("reg.model")], spark)
    main(["regimes-apply", "--in", p("ind.parquet"), "--out", p("reg2.parquet"), "--model", p("reg.model")], spark)
    a, b = (sorted(map(tuple, spark.read.parquet(p(n)).select("sample_id", "regime_label", "risk_score").collect())) for n in ("reg.parquet", "reg2.parquet"))
    assert a == b and len(a) == 300
    main(["embeddings", "--in", p("reg.parquet"), "--out", p("emb.parquet"), "--model", p("emb.model"), "--config", p("e.json")], spark)
    main(["embeddings-apply", "--in", p("reg.parquet"), "--out", p("emb2.parquet"), "--model", p("emb.model")], spark)
    (tmp_path / "h.json").write_text('{"iterations": 2}')
    main(["stability", "--in", p("reg.parquet"), "--out", p("stab.parquet"), "--model", p("hmm.model"), "--config", p("h.json")], spark)
    main(["stability-apply", "--in", p("reg.parquet"), "--out", p("stab2.parquet"), "--model", p("hmm.model")], spark)
    main(["policies", "--in", p("stab.parquet"), "--out", p("act.parquet")], spark)
    acts = spark.read.parquet(p("act.parquet"))
    assert acts.count() == 300 and {r.action for r in acts.select("action").distinct().collect()} <= {"HOLD", "RESCAN", "CONFIRM"}
    main(["reports", "--in", p("act.parquet"), "--out", p("reports")], spark)
    assert "Operator report" in "\n".join(r.value for r in spark.read.text(p("reports/operator")).collect())


def test_probes(spark):
    import numpy as np

    from tidemark.plans import probes

    rows = {(r.sigma, r.gain): r for r in probes.recovery(spark, [0.0, 0.05], [0.0, 0.3], families=20).collect()}
    assert rows[0.0, 0.0].rmse < 1e-9 and rows[0.0, 0.0].slope == pytest.approx(1) and rows[0.0, 0.0].invalid == 0
    assert rows[0.0, 0.3].rmse > rows[0.05, 0.0].rmse / 10 and rows[0.05, 0.0].rmse < 0.3
    assert {r.sigma: r.tolerated_gain for r in probes.tolerance(probes.recovery(spark, [0.0], [0.0, 0.01], families=10)).collect()}[0.0] >= 0.0
    power = probes.detection_power(spark, [0.02, 2.0], families=30).cache()
    assert {r.power for r in power.filter("dose = 2 AND detector = 'oracle'").collect()} == {1.0}
    assert {r.detector: r.first_dose for r in probes.detection_limit(power).collect()}["oracle"] == 2.0
    assert simulate.illumination(simulate.grid(), {"kind": "piecewise", "values": [1, 2, 4]}).max() == 1
