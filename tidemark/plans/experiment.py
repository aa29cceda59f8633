"""Experiments: splits before fits, baselines and ablation arms over shared frames, acceptance, selection.

An experiment is a long table of metrics keyed by method, scenario, seed and split; the arms share frames
and differ by the function that turns them into actions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.keys import split_of
from tidemark.functions.scalars import toggle_reduction
from tidemark.operators import events, folds, metrics, regimes, windows
from tidemark.operators.ranges import kept

Arm = Callable[[DataFrame], DataFrame]


def with_regimes(frames: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Split by sequence, boundaries from training hazards alone, regimes and risk everywhere."""
    split = frames.withColumn("split", split_of(F.col("sequence_id"), train, val))
    cuts = regimes.fit_boundaries(split.filter("split = 'train'"), "score", F.col("label") == "hazard")
    return regimes.apply_boundaries(split, "score", cuts).withColumn("score", F.col("risk_score"))


def _labelled(actions: DataFrame, frames: DataFrame) -> DataFrame:
    keep = [c for c in ("label", "split") if c not in actions.columns]
    return actions.join(frames.select("sample_id", *keep), "sample_id") if keep else actions


def baselines(threshold: float = 0.5) -> dict[str, Arm]:
    """B0: the score's own threshold. B1: N of M. B2: hysteresis. B3: EWMA and CUSUM."""
    return {
        "B0": lambda f: f.withColumn("action", F.when(F.col("score") >= threshold, "CONFIRM").otherwise("HOLD")),
        "B1": lambda f: _labelled(folds.n_of_m(f, 3, 5, threshold, 2), f),
        "B2": lambda f: _labelled(folds.hysteresis(f, 0.7, 0.3, 3), f),
        "B3": lambda f: _labelled(folds.ewma_cusum(f, 0.3, 0.4, 2.0, threshold), f),
    }


def evaluate(actions: DataFrame, by: list[str] = ("split",)) -> DataFrame:
    """One row per group: event rates, toggle rate, suppression."""
    by = list(by)
    keys = actions.select("sequence_id", *by).distinct()
    found = events.alarm_events(actions).join(keys, "sequence_id")
    toggles = windows.toggle_rates(actions).join(keys, "sequence_id").groupBy(*by).agg(F.avg("toggle_rate").alias("toggle_rate"))
    return toggles.join(events.event_rates(found, by), by, "left").join(events.suppression(actions, by), by).fillna({"fcr": 0.0, "mcr": 1.0, "n_events": 0})


def run_arms(frames: DataFrame, arms: dict[str, Arm]) -> DataFrame:
    """Metrics of every arm over the same frames, with the arm's name. Every arm reads the frames several times, so they
    are made once."""
    out, frames = None, kept(frames)
    for name, arm in arms.items():
        rows = evaluate(arm(frames)).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def deltas(rows: DataFrame, reference: str, columns=("fcr", "mcr", "toggle_rate"), by: list[str] = ("split",)) -> DataFrame:
    """Every method against the reference in the same group."""
    base = rows.filter(F.col("method") == reference).select(*by, *[F.col(c).alias(f"base_{c}") for c in columns])
    return rows.filter(F.col("method") != reference).join(base, list(by)).select("method", *by, *[(F.col(c) - F.col(f"base_{c}")).alias(f"delta_{c}") for c in columns])


def acceptance(rows: DataFrame, method: str, split: str = "test") -> DataFrame:
    """Criteria of a method against B0 and B1 on one split: name, value, threshold, status. What can't be
    told is unevaluable, not passed."""
    here = rows.filter(F.col("split") == split)
    one = lambda m: F.max(F.when(F.col("method") == m, F.struct("fcr", "mcr", "toggle_rate")))
    wide = here.agg(one(method).alias("own"), one("B0").alias("b0"), one("B1").alias("b1"))
    own, b0, b1 = F.col("own"), F.col("b0"), F.col("b1")
    criteria = [
        ("toggle_reduction_vs_b0", F.when(b0.isNotNull(), toggle_reduction(own["toggle_rate"], b0["toggle_rate"])), 0.50, False),
        ("toggle_reduction_vs_b1", F.when(b1.isNotNull(), toggle_reduction(own["toggle_rate"], b1["toggle_rate"])), 0.30, False),
        ("mcr_delta_bound", own["mcr"] - F.coalesce(b0["mcr"], b1["mcr"]), 0.05, True),
        ("nominal_benign_fcr_threshold", own["fcr"], 0.01, True),
        ("robustness_catastrophic_failure", own["fcr"], 0.10, True),
    ]
    cells = [F.struct(F.lit(n).alias("criterion"), v.cast("double").alias("value"), F.lit(t).alias("threshold"), metrics.status(v, t, most).alias("status")) for n, v, t, most in criteria]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def graceful(stress: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Largest rise of each delta from one severity to the next, against its limit; with fewer than two
    severities unevaluable. stress: severity, name and delta columns."""
    w = Window.orderBy("severity", "name")  # a row per stress scenario
    steps = stress.select("severity", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in limits])
    row = steps.agg(F.count_distinct("severity").alias("n"), *[F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in limits])
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(t).alias("threshold"), F.when(F.col("n") < 2, "unevaluable").otherwise(metrics.status(F.col(c), t, True)).alias("status")) for c, t in limits.items()]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def monotonicity(bins: DataFrame) -> DataFrame:
    """Falls of the target along calibration bins ordered by prediction."""
    w = Window.orderBy("pred_mean", "target_mean")  # ten bins
    falls = bins.withColumn("fall", F.col("target_mean") + 1e-12 < F.lag("target_mean").over(w))
    n = F.count("*")
    return falls.agg(F.count_if("fall").alias("violations"), F.when(n < 2, "unevaluable").when(F.count_if("fall") == 0, "pass").otherwise("fail").alias("status"))


def select_candidate(candidates: DataFrame) -> DataFrame:
    """Candidates in order, best first; the first acceptable one is selected. Errors are candidates that rank
    last. Columns: name, acceptable, failed, fcr, mcr, toggle_rate, simplicity, position."""
    key = [F.col("failed").cast("int"), (~F.col("acceptable")).cast("int"), "fcr", "mcr", "toggle_rate", "simplicity", "position", "name"]
    ranked = candidates.withColumn("place", F.row_number().over(Window.orderBy(*[F.col(k) if isinstance(k, str) else k for k in key])))  # a row per candidate
    return ranked.withColumn("selected", (F.col("place") == 1) & F.col("acceptable") & ~F.col("failed"))


def decision_rule(contrasts: DataFrame, seeds: list[int], least: int = 2) -> DataFrame:
    """Per arm and reference over seeds: the rate must improve with its interval under zero in `least` seeds, in one
    direction in all, and the miss rate must not worsen in any. A seed that can't be told fails the rule.
    contrasts: arm, reference, seed, fcr, fcr_low, fcr_high, mcr_low."""
    told = F.col("fcr").isNotNull() & F.col("fcr_high").isNotNull() & F.col("mcr_low").isNotNull()
    per = contrasts.filter(F.col("seed").isin(seeds)).groupBy("arm", "reference").agg(
        F.count_if(told).alias("told"), F.count_if(told & (F.col("fcr_high") < 0)).alias("improved"),
        F.count_if(told & (F.col("fcr") < 0)).alias("falls"), F.count_if(told & (F.col("mcr_low") > 0)).alias("worse"),
    )
    every = F.col("told") == len(seeds)
    return per.select(
        "arm", "reference", (every & (F.col("improved") >= least) & (F.col("falls") == len(seeds))).alias("fcr_rule_met"),
        (every & (F.col("worse") == 0)).alias("mcr_safety_met"),
    )


def useful_arms(rules: DataFrame) -> DataFrame:
    return rules.groupBy("arm").agg(F.bool_and(F.col("fcr_rule_met") & F.col("mcr_safety_met")).alias("useful"))


def quality_gates(counts: dict[str, int | None], least: dict[str, int]) -> dict[str, str]:
    return {k: "unevaluable" if counts.get(k) is None else "pass" if counts[k] >= n else "fail" for k, n in least.items()}


def zero_failure_floor(p: float, alpha: float = 0.05) -> int:
    """Sequences without failure that put its probability under p at level alpha."""
    return math.ceil(math.log(alpha) / math.log1p(-p))


def zero_failure_column(p: Column, alpha: float = 0.05) -> Column:
    """The same for a column of probabilities."""
    return F.ceil(F.lit(math.log(alpha)) / F.log1p(-p)).cast("long")


def attribution(criteria: DataFrame) -> DataFrame:
    """Failed and open criteria with the family they belong to."""
    name = F.col("criterion")
    family = F.when(name.contains("toggle"), "stability").when(name.contains("mcr"), "misses").when(name.contains("fcr") | name.contains("catastrophic"), "false_alarms").otherwise("other")
    return criteria.filter("status <> 'pass'").withColumn("family", family)


def corresponds(hashes: DataFrame, expected: str) -> DataFrame:
    """Side inputs (name, config_hash) that were made under another configuration."""
    return hashes.filter(~F.col("config_hash").eqNullSafe(expected))


def progression(benign: tuple[int, int] | None, frontier: dict[str, tuple[int, int]], calibration: int) -> str:
    """Verdict from counts: benign false positives and detections per target cell (successes, trials)."""
    from tidemark.operators.resample import exact_interval

    if calibration < 99 or benign is None or not benign[1] or not any(n for _, n in frontier.values()):
        return "UNEVALUABLE"
    usable = {k: exact_interval(*v) for k, v in frontier.items() if v[1] >= 10}
    if exact_interval(*benign)[0] > 0.01:
        return "UNFAVORABLE"
    if any(k.endswith("decade=-2") and low >= 0.5 for k, (low, _) in usable.items()):
        return "FAVORABLE"
    if len(usable) == len(frontier) and all(high <= 0.25 for _, high in usable.values()):
        return "UNFAVORABLE"
    return "INCONCLUSIVE"


def finite_interval(draws: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    from tidemark.functions.scalars import finite

    v = F.when(finite(F.col(value)), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(q[0].alias("low"), q[1].alias("high"), F.count(v).alias("n_finite"))


def display_policy(results: DataFrame, confirm: Column | None, rescan: Column | None) -> DataFrame:
    """Actions of a calibrated policy; without thresholds every frame is UNEVALUABLE."""
    if confirm is None or rescan is None:
        return results.withColumn("action", F.lit("UNEVALUABLE"))
    return results.withColumn("action", F.when(F.col("score").isNull(), "UNEVALUABLE").when(F.col("score") > confirm, "CONFIRM").when(F.col("score") > rescan, "RESCAN").otherwise("HOLD"))


def reload_run(spark, path: str, config: dict, split: str) -> dict[str, DataFrame]:
    """The tables of a finished run, for arms that are to stand beside it: the run must have been made under this
    configuration and evaluated on this split. path holds run.json (config_hash, evaluation_split, tables)."""
    from tidemark.sources.sinks import sha256_json

    kept = spark.read.schema("config_hash string, evaluation_split string, tables map<string, string>").option("multiLine", True).json(f"{path}/run.json").first()
    if kept is None or kept["evaluation_split"] != split:
        raise ValueError(f"the run was not evaluated on {split}")
    if kept["config_hash"] != sha256_json(config):
        raise ValueError("the run was made under another configuration")
    return {name: spark.read.parquet(f"{path}/{place}") for name, place in (kept["tables"] or {}).items()}


def save_run(path: str, config: dict, split: str, tables: dict[str, DataFrame]) -> None:
    from tidemark.sources.sinks import sha256_json, write_json, write_parquet

    for name, rows in tables.items():
        write_parquet(rows, f"{path}/{name}")
    write_json(f"{path}/run.json", {"config_hash": sha256_json(config), "evaluation_split": split, "tables": {n: n for n in tables}})


def diagnose(actions: DataFrame, assignment: DataFrame, unit: str) -> DataFrame:
    """Actions by scenario, split and label, with a note where splits could not be told."""
    from tidemark.operators.contracts import attach_split

    known = attach_split(actions, assignment, unit)
    out = known.groupBy("scenario_id", "split", "label").agg(
        F.count("*").alias("n"), F.count_if(F.col("action") == "CONFIRM").alias("n_confirm"), F.count_if(F.col("action") == "RESCAN").alias("n_rescan"), F.avg((F.col("action") == "HOLD").cast("double")).alias("share_held")
    )
    return out.withColumn("note", F.when(F.col("split") == "unavailable", "no split assignment").otherwise(""))
