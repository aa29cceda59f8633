"""Regimes: distance from hazards, quantile boundaries fitted once, labels and risk by frozen boundaries."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantile_values

LABELS = ("trusted", "ambiguous", "degraded", "high_risk")
QUANTILES = (0.5, 0.75, 0.9)
VERSION = "regime_model.v1"


def fit_boundaries(frames: DataFrame, distance: str, hazard: Column, quantiles=QUANTILES) -> tuple[float, ...]:
    """Exact interpolated quantiles of the hazards' distance. A small distance is hazard-like."""
    row = quantile_values(frames.filter(hazard), distance, list(quantiles))
    if row is None:
        raise ValueError("no hazard rows to fit boundaries to")
    return tuple(row)


def regime_label(d: Column, cuts: tuple[float, ...], labels=LABELS) -> Column:
    out = F.when(d <= cuts[0], labels[0])
    for cut, name in zip(cuts[1:], labels[1:]):
        out = out.when(d <= cut, name)
    return out.otherwise(labels[-1])


def risk_score(d: Column, cuts: tuple[float, ...], low: float = 0.0, high: float = 1.0) -> Column:
    """Distance rescaled so that the first boundary is 0 and the last 1, clamped."""
    base = (d - cuts[0]) / max(cuts[-1] - cuts[0], 1e-12)
    return F.when(F.isnan(base) | base.isNull(), low).otherwise(F.least(F.greatest(base, F.lit(low)), F.lit(high)))


def apply_boundaries(frames: DataFrame, distance: str, cuts: tuple[float, ...]) -> DataFrame:
    d = F.col(distance)
    return frames.withColumns({"regime_label": regime_label(d, cuts), "risk_score": risk_score(d, cuts), "distance_to_boundary": d - cuts[0]})


def fit_distance(frames: DataFrame, vector: str, size: int, hazard: Column, weights: list[float] | None = None, metric: str = "mahalanobis") -> dict:
    """Mean of hazards and inverse covariance in weighted space, from packed partial sums over the hazards."""
    import numpy as np

    from tidemark.operators.spectra import scatter

    root = np.sqrt(np.ones(size) if weights is None else np.asarray(weights, float))
    z = F.zip_with(F.slice(vector, 1, size), F.lit(root.tolist()), lambda x, w: x.cast("double") * w)
    n, total, outer = scatter(frames.filter(hazard).select(z.alias("z")), "z")
    mean = total / n
    state = {"version": VERSION, "metric": metric, "root_weights": root.tolist(), "mean": mean.tolist()}
    if metric == "mahalanobis":
        cov = (outer - n * np.outer(mean, mean)) / (n - 1) + np.eye(size) * 1e-9 if n > 1 else np.eye(size) * 1e-6
        state["inverse"] = np.linalg.pinv(cov + np.eye(size) * 1e-6).tolist()
    return state


def distance(vector: Column, state: dict) -> Column:
    """Distance from the hazards' mean, an expression with the fitted numbers as literals."""
    size = len(state["mean"])
    delta = F.zip_with(
        F.zip_with(vector, F.lit(state["root_weights"]), lambda x, w: x.cast("double") * w), F.lit(state["mean"]), lambda z, m: z - m
    )
    if state["metric"] != "mahalanobis":
        return F.sqrt(F.aggregate(delta, F.lit(0.0), lambda a, x: a + x * x))
    rows = F.lit(state["inverse"]) if size else None
    inner = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, delta, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    total = F.aggregate(F.zip_with(inner, delta, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def dump(state: dict) -> str:
    return json.dumps(state, sort_keys=True, separators=(",", ":"), allow_nan=False)


def load(text: str, version: str = VERSION) -> dict:
    """A frozen model; unknown versions and numbers that are not finite are refused."""
    state = json.loads(text, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(f"not finite: {x}")))
    if state.get("version") != version:
        raise ValueError(f"unknown version {state.get('version')!r}, expected {version!r}")
    if not all(math.isfinite(x) for x in state["mean"]):
        raise ValueError("model has numbers that are not finite")
    return state
