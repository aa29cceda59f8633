"""Latents of simulated sequences, as expressions: every draw is a digest of (seed, name of the sequence, name of the
latent), so a table of them is a projection, the same however it is cut, and SQL can make it too."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import fraction

HAZARDS = ("hazard_a", "hazard_b")
NAMES = ("hazard_a", "hazard_b", "water", "background")
DRIFT = {"humidity": 0.02, "dust": 0.01}
PRIORS = {
    "path": {"prior": "uniform", "min": 0.8, "max": 1.2}, "humidity": {"prior": "uniform", "min": 0.0, "max": 1.0}, "dust": {"prior": "uniform", "min": 0.0, "max": 1.0},
    "angle": {"prior": "uniform", "min": 0.0, "max": 40.0}, "kelvin": {"prior": "uniform", "min": 2800.0, "max": 6000.0}, "concentration": {"prior": "loguniform", "min": 0.1, "max": 1.0},
    "level": {"prior": "uniform", "min": 0.02, "max": 0.05}, "tilt": {"prior": "normal", "mean": 0.0, "std": 0.005}, "bend": {"prior": "normal", "mean": 0.0, "std": 0.005},
    "share": {"prior": "uniform", "min": 0.3, "max": 0.7}, "sigma": {"prior": "uniform", "min": 0.002, "max": 0.01},
} | {f"offset_{k}": {"prior": "normal", "mean": 0.0, "std": 0.01} for k in range(8)}


def uniform(key: Column, name: str, seed: int) -> Column:
    return fraction(F.concat(key, F.lit(f"|{name}")), seed)


def drawn(prior: dict, key: Column, name: str, seed: int) -> Column:
    """A value of a prior: uniform, loguniform, or normal (by Box and Muller) within its ends if it has any."""
    u = uniform(key, name, seed)
    if prior["prior"] == "uniform":
        return prior["min"] + u * (prior["max"] - prior["min"])
    if prior["prior"] == "loguniform":
        low, high = math.log(prior["min"]), math.log(prior["max"])
        return F.exp(low + u * (high - low))
    if prior["prior"] == "normal":
        radius = F.sqrt(-2 * F.log(1 - u))
        x = prior["mean"] + prior["std"] * radius * F.cos(2 * math.pi * uniform(key, f"{name}~", seed))
        x = x if prior.get("min") is None else F.greatest(x, F.lit(float(prior["min"])))
        return x if prior.get("max") is None else F.least(x, F.lit(float(prior["max"])))
    raise ValueError(f"unknown prior {prior['prior']!r}")


def mixed(key: Column, agents: list[str], least: int, most: int, seed: int) -> Column:
    """Between least and most agents without replacement, the ones of the least digests, with weights that are uniform
    on the simplex: exponential draws over their sum. A map by weight, the greatest first."""
    n = least + F.floor(uniform(key, "components", seed) * (most - least + 1)).cast("int")
    dealt = F.array_sort(F.array(*[F.struct(uniform(key, f"pick {a}", seed).alias("at"), F.lit(a).alias("agent"), (-F.log(1 - uniform(key, f"weight {a}", seed))).alias("w")) for a in agents]))
    own = F.slice(dealt, 1, n)
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["w"])
    by_weight = F.sort_array(F.transform(own, lambda x: F.struct((x["w"] / total).alias("weight"), x["agent"].alias("agent"))), asc=False)
    return F.map_from_arrays(F.transform(by_weight, lambda x: x["agent"]), F.transform(by_weight, lambda x: x["weight"]))


def episode(key: Column, frames: int, seed: int) -> tuple[Column, Column]:
    """Onset (1 to 6) and duration (3 frames or more) of a hazard episode."""
    onset = 1 + F.floor(uniform(key, "onset", seed) * (min(7, max(2, frames - 3)) - 1))
    room = F.greatest(F.lit(4), frames - onset + 1) - 3
    return onset.cast("int"), (3 + F.floor(uniform(key, "duration", seed) * room)).cast("int")


def frames_of(sequences: DataFrame, frames: int = 10, seed: int = 7, episodes: bool = False, independent: bool = False) -> DataFrame:
    """Frames (sequence_id, timestamp, sample_id, label, latents, mixture) of sequences (sequence_id). Latents are those
    of the sequence, with drift, or where independent is true each frame's own."""
    name = F.concat("sequence_id", F.lit("_"), F.lpad(F.col("t").cast("string"), 3, "0"))
    each = sequences.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("sample_id", name)
    if independent:
        return _drawn(each.withColumn("key", F.col("sample_id")), frames, seed, episodes, False)
    held = _draws(sequences.withColumn("key", F.col("sequence_id")), frames, seed, episodes)
    return _at_times(held.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("sample_id", name), True)


def _drawn(rows: DataFrame, frames: int, seed: int, episodes: bool, drifts: bool) -> DataFrame:
    return _at_times(_draws(rows, frames, seed, episodes), drifts)


def _draws(rows: DataFrame, frames: int, seed: int, episodes: bool) -> DataFrame:
    key = F.col("key")
    onset, duration = episode(key, frames, seed) if episodes else (F.lit(0), F.lit(frames))
    agent = F.element_at(F.array(*map(F.lit, HAZARDS)), (1 + F.floor(uniform(key, "agent", seed) * len(HAZARDS))).cast("int"))
    return rows.withColumns({n: drawn(p, key, n, seed) for n, p in PRIORS.items()}).withColumns({
        "is_hazard": uniform(key, "hazard", seed) < 0.5, "onset": onset, "duration": duration, "agent": agent,
    })


def _at_times(rows: DataFrame, drifts: bool) -> DataFrame:
    t, share = F.col("t"), F.col("share")
    on = F.col("is_hazard") & (t >= F.col("onset")) & (t < F.col("onset") + F.col("duration"))
    left = F.when(on, 1 - share).otherwise(1.0)
    weights = [F.when(on & (F.col("agent") == h), share).otherwise(0.0) for h in HAZARDS] + [(1 - share) * left, share * left]
    present = F.filter(F.array(*[F.struct(w.alias("w"), F.lit(n).alias("n")) for w, n in zip(weights, NAMES)]), lambda x: x["w"] > 0)
    ordered = F.sort_array(present, asc=False)
    moved = {k: F.col(k) + (t * d if drifts else 0) for k, d in DRIFT.items()}
    latents = F.struct(
        "path", *[moved.get(k, F.col(k)).alias(k) for k in ("humidity", "dust", "angle", "kelvin", "concentration")],
        F.array(*[F.col(f"offset_{k}") for k in range(8)]).alias("offsets"), F.array("level", "tilt", "bend").alias("baseline"),
    )
    mixture = F.struct(F.transform(ordered, lambda x: x["n"]).alias("components"), F.transform(ordered, lambda x: x["w"]).alias("weights"))
    return rows.select(
        "sample_id", "sequence_id", t.cast("double").alias("timestamp"), F.when(on, "hazard").otherwise("benign").alias("label"), "sigma", "onset", "duration",
        latents.alias("latents"), F.array(*weights).alias("amounts"), mixture.alias("mixture"),
    )
