"""Separability audits: probes by scenario, detectability bins, envelopes, label integrity, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import metrics
from tidemark.operators.quantiles import attach, quantile_values, quantiles

POOLED = "pooled"


def with_pooled(frames: DataFrame) -> DataFrame:
    """All scenarios again under one name."""
    return frames.unionByName(frames.withColumn("scenario_id", F.lit(POOLED)))


def probes(frames: DataFrame, scores: list[str], positive: Column, least: int = 20) -> DataFrame:
    """AUC, average precision and status of each probe in each scenario and over all; fewer than `least` rows of
    a class are underpowered."""
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("probe"), F.col(s).cast("double").alias("value")) for s in scores])).alias("p")
    long = with_pooled(frames).select("scenario_id", positive.alias("y"), parts).select("scenario_id", "y", "p.*").filter(~F.isnan("value") & F.col("value").isNotNull())
    keys = ["scenario_id", "probe"]
    both = metrics.roc_auc(long, "value", F.col("y"), keys).join(metrics.average_precision(long, "value", F.col("y"), keys), keys)
    few = (F.col("n_pos") < least) | (F.col("n_neg") < least)
    return both.withColumn("status", F.when(few, "underpowered").when(F.col("auc").isNull(), "unevaluable").otherwise("evaluated"))


def label_integrity(frames: DataFrame, components: Column, hazards: list[str], label: Column) -> DataFrame:
    """Labels against what the mixture says: mismatches, rate, and the first five."""
    truth = F.exists(components, lambda c: c.isin(*hazards))
    bad = truth != (label == "hazard")
    marked = frames.withColumn("__bad", bad)
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("__bad"), F.col("sample_id")))), 1, 5)
    return marked.filter("__bad").agg(first.alias("examples")).join(
        F.broadcast(marked.agg(F.count("*").alias("n_rows"), F.count_if("__bad").alias("n_mismatch"), F.avg(F.col("__bad").cast("double")).alias("rate")))
    )


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    return quantile_values(df, value, [i / bins for i in range(bins + 1)])


def detectability_bins(frames: DataFrame, strength: str, score: str, positive: Column, bins: int, gate: float) -> DataFrame:
    """AUC of hazards in each bin of strength against all benign rows, and whether it meets the gate."""
    hazards, benign = frames.filter(positive), frames.filter(~positive)
    edges = quantile_edges(hazards, strength, bins)
    x, which = F.col(strength), None
    for i in range(bins):
        inside = (x >= edges[i]) & ((x < edges[i + 1]) if i < bins - 1 else (x <= edges[i + 1]))
        which = F.when(inside, i) if which is None else which.when(inside, i)
    # benign rows stand against every bin: one copy each for a fixed, small number of bins
    spread = benign.select(F.col(score).alias("s"), F.lit(False).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = hazards.select(F.col(score).alias("s"), F.lit(True).alias("y"), which.alias("bin")).filter("bin IS NOT NULL").union(spread)
    out = metrics.roc_auc(rows, "s", F.col("y"), ["bin"])
    lower = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    return out.withColumns({"lower": lower, "passes": F.coalesce(F.col("auc") >= gate, F.lit(False))})


def trend(bins: DataFrame, margin: float = 0.05) -> DataFrame:
    """Whether the last bin's AUC is above the first's by the margin."""
    ends = bins.agg(F.min_by("auc", "bin").alias("first"), F.max_by("auc", "bin").alias("last"))
    return ends.withColumn("tracks_detectability", F.coalesce(F.col("last") - F.col("first") >= margin, F.lit(False)))


def envelope(frames: DataFrame, strength: str, score: str, positive: Column, levels: list[float], gate: float) -> DataFrame:
    """At each level: benign rows and hazards of at least that strength, how many hazards remain, and the AUC.

    A hazard counts at all levels up to its strength, so rows are explored by level once, over a fixed list."""
    steps = F.array(*[F.lit(float(v)) for v in sorted(levels)])
    at = F.when(positive, F.filter(steps, lambda v: v <= F.col(strength))).otherwise(steps)
    rows = frames.select(positive.alias("y"), F.col(score).alias("s"), F.explode(at).alias("level"))
    total = frames.filter(positive).count()
    out = metrics.roc_auc(rows, "s", F.col("y"), ["level"])
    return out.withColumns({"retained": F.col("n_pos") / max(total, 1), "passes": F.coalesce(F.col("auc") >= gate, F.lit(False))})


def lowest_passing(levels: DataFrame) -> DataFrame:
    return levels.agg(F.min(F.when(F.col("passes"), F.col("level"))).alias("level"), F.count_if("passes").alias("n_passing"))


def verdict(s: DataFrame, gate: float = 0.8, tolerance: float = 0.02) -> DataFrame:
    """Verdict of the ceiling audit from a one-row summary: n_mismatch, underpowered, ceiling_auc, ceiling_low,
    ceiling_high, raw_auc, raw_low, tracks, only_highest_pass. Earlier reasons outrank later ones."""
    c, r = F.col("ceiling_auc"), F.col("raw_auc")
    at_chance = (F.col("ceiling_low") <= 0.5) & (F.col("ceiling_high") >= 0.5)
    invalid = c.isNull() | (c < 0.5 - tolerance) | F.coalesce(F.col("ceiling_high") < 0.5, F.lit(False))
    out = (
        F.when(F.col("n_mismatch") > 0, "label_provenance_bug").when(F.col("underpowered"), "underpowered_inconclusive").when(invalid, "ceiling_invalid")
        .when(at_chance & (F.col("raw_low") > 0.5) & ~F.col("tracks"), "no_grounded_separability_confound")
        .when((c < gate) & F.col("only_highest_pass"), "generative_subnoise").when((c >= gate) & (r < gate), "indicator_information_loss")
        .when((c >= gate) & (r >= gate), "both_present").otherwise("inconclusive")
    )
    return s.withColumn("verdict", out)


def ground_truth(frames: DataFrame, latents: Column, mixture: Column, hazards: list[str]) -> DataFrame:
    """One row per sequence from JSON latents: targets, concentration, decade, worst clipping, length."""
    mix = F.from_json(mixture, "struct<components: array<string>, weights: array<double>>")
    conc = F.from_json(latents, "struct<concentration: double>")["concentration"]
    names = sorted(set(hazards))
    own = frames.select("sequence_id", "clipping_fraction", conc.alias("c"), mix["components"].alias("m"))
    out = own.groupBy("sequence_id").agg(
        *[F.max(F.array_contains("m", name)).alias(f"__t{i}") for i, name in enumerate(names)], F.exp(F.avg(F.ln("c"))).alias("concentration"),
        F.max("clipping_fraction").alias("max_clipping"), F.count("*").alias("n_frames"),
    )
    targets = F.array_compact(F.array(*[F.when(F.col(f"__t{i}"), F.lit(name)) for i, name in enumerate(names)]))
    out = out.withColumn("targets", targets).drop(*[f"__t{i}" for i in range(len(names))])
    out = attach(out, quantiles(frames, "clipping_fraction", [0.5], ["sequence_id"]), ["sequence_id"])
    out = out.withColumn("median_clipping", F.col("q")[0]).drop("q")
    decade = F.floor(F.log10("concentration") + 1e-12).cast("int")
    return out.withColumns({"identity": F.when(F.size("targets") == 0, "none").otherwise(F.array_join("targets", "+")), "decade": decade})


def frontier(truth: DataFrame, detected: Column) -> DataFrame:
    """Detections by identity and decade, by each alone, and over all, from one pass."""
    return metrics.strata_rates(truth, detected, [["identity", "decade"], ["identity"], ["decade"], []])


def first_dose(power: DataFrame, target: float = 0.95) -> DataFrame:
    return power.groupBy("detector").agg(F.min(F.when(F.col("power") >= target, F.col("dose"))).alias("first_dose"))


def remaining_best(candidates: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Best candidate of each group, first one on ties of position."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), "position")
    return candidates.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
