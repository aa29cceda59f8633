"""Scalar functions: text, numbers, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def alert_token(text: Column) -> Column:
    return F.translate(F.upper(F.trim(text)), "- ", "__")


def float_text(x: Column) -> Column:
    """Six decimals without trailing zeros or point."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def holds_phrase(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def reason_codes(text: Column) -> Column:
    """Codes from a JSON list or a text of codes split by comma, semicolon or bar."""
    parsed = F.from_json(text, "array<string>")
    listed = F.filter(F.transform(F.split(text, r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), parsed).otherwise(listed)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def null_if_not_finite(x: Column) -> Column:
    return F.when(finite(x), x)


def clip(x: Column, low: float, high: float, nan: float | None = None) -> Column:
    """NaN sorts above all numbers in Spark, so it is put aside first."""
    inner = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.when(F.isnan(x), F.lit(low if nan is None else nan)).otherwise(inner)


def entropy(p: Column) -> Column:
    inner = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0)))
    return -F.aggregate(inner, F.lit(0.0), lambda a, x: a + x * F.log(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def argmax_first(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def dominant(components: Column, weights: Column) -> Column:
    return F.element_at(components, F.array_position(weights, F.array_max(weights)).cast("int"))


def effective_path(length: Column, humidity: Column, dust: Column, angle_degrees: Column) -> Column:
    return length * (1 + 0.25 * humidity) * (1 + 0.05 * dust) / F.greatest(F.cos(F.radians(angle_degrees)), F.lit(0.2))


def log1p_exp(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def switch_step(log_odds: Column, eta: float) -> Column:
    """Log odds after a step of a symmetric two-state chain that switches with probability eta."""
    import math

    stay, turn = math.log(1 - eta), math.log(eta)
    top = F.greatest(log_odds + stay, F.lit(turn))
    low = F.greatest(log_odds + turn, F.lit(stay))
    up = top + F.log(F.exp(log_odds + stay - top) + F.exp(turn - top))
    down = low + F.log(F.exp(log_odds + turn - low) + F.exp(stay - low))
    return up - down


def episode_category(first: Column, onset: Column, duration: Column) -> Column:
    return (
        F.when(first.isNull(), "absent").when(first < onset, "early")
        .when(first < onset + duration, "in_window").otherwise("late")
    )


def toggle_reduction(pipeline: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (baseline - pipeline) / baseline).otherwise(F.when(pipeline <= 0, 0.0).otherwise(-1.0))


def normalised(s: Column, mode: str, step: float = 1.0) -> Column:
    """Spectrum over its maximum or its area, guarded."""
    if mode == "none":
        return s
    below = F.array_max(s) if mode == "unit_max" else F.aggregate(s, F.lit(0.0), lambda a, x: a + x) * step
    return F.transform(s, lambda x: x / F.greatest(below, F.lit(EPS)))
