"""Spectral transforms. On a shared grid every linear step is one constant matrix, made on the driver
and shipped with the function; rows are worked off in Arrow batches, independent of each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.sources.frames import map_slices

_EPS = 1e-12


@dataclass(frozen=True)
class IndicatorConfig:
    normalization: str = "unit_max"
    smoothing: str = "savitzky_golay"
    window: int = 11
    poly_order: int = 3
    clip: tuple[float, float, float] = (0.0, 1.0, 1e-9)
    baseline: str = "poly2"
    robust: bool = False
    rescale: bool = True
    snr_mode: str = "residual"
    noise_stat: str = "mad"
    signal_stat: str = "median"
    snr_max: float = 1e6
    band_stat: str = "mean"
    ratio_max: float = 1e6
    bands: tuple = (((1200, 1250), (1350, 1400)), ((1500, 1560), (1700, 1760)), ((1010, 1060), (1300, 1350)))
    entropy_bins: int = 0
    entropy_residual: bool = True
    eps: float = 1e-9
    extra: dict = field(default_factory=dict)


def normalise(y, mode: str):
    import numpy as np

    if mode == "none":
        return y.copy(), np.zeros(len(y), bool)
    below = y.max(1) if mode == "unit_max" else y.sum(1)
    return y / np.maximum(below, _EPS)[:, None], below <= _EPS


def moving_average_matrix(n: int, window: int):
    """Mean over a centred window; ends repeat the edge value."""
    import numpy as np

    out, half = np.zeros((n, n)), window // 2
    for shift in range(-half, window - half):
        np.add.at(out, (np.arange(n), np.clip(np.arange(n) + shift, 0, n - 1)), 1 / window)
    return out


def savgol_matrix(n: int, window: int, order: int):
    """Least-squares polynomial in each centred window; the first and last window's polynomial fills the ends."""
    import numpy as np

    half = window // 2
    t = np.arange(window) - half
    hat = np.vander(t, order + 1) @ np.linalg.pinv(np.vander(t, order + 1))
    out = np.zeros((n, n))
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        out[i, start : start + window] = hat[i - start]
    return out


def poly_matrix(n: int, degree: int):
    """Coefficients (lowest first) of a polynomial on the scaled grid from -1/2 to 1/2, and the design."""
    import numpy as np

    t = np.linspace(-0.5, 0.5, n)
    design = np.vander(t, degree + 1, increasing=True)
    return np.linalg.pinv(design), design


def huber_poly(y, design, delta: float = 1.0, steps: int = 50):
    """Polynomial of least Huber loss, by reweighting; convex, so the minimiser is the same for any method."""
    import numpy as np

    out = np.empty((len(y), design.shape[1]))
    for i, row in enumerate(y):
        beta = np.linalg.lstsq(design, row, rcond=None)[0]
        for _ in range(steps):
            r = np.abs(row - design @ beta)
            w = np.sqrt(np.where(r <= delta, 1.0, delta / np.maximum(r, _EPS)))
            new = np.linalg.lstsq(design * w[:, None], row * w, rcond=None)[0]
            done = np.max(np.abs(new - beta)) < 1e-12
            beta = new
            if done:
                break
        out[i] = beta
    return out


def spline_smoother(n: int, penalty: float):
    """Hat matrix of a penalised cubic (second-difference) smoother on an even grid. It stands in for a
    smoothing spline with free knots and is not identical to one."""
    import numpy as np

    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.inv(np.eye(n) + penalty * d.T @ d)


def noise(y, stat: str, eps: float):
    import numpy as np

    if stat == "std":
        return np.maximum(y.std(1), eps)
    return 1.4826 * np.maximum(np.median(np.abs(y - np.median(y, 1, keepdims=True)), 1), eps)


def band(y, wavelengths, low: float, high: float, stat: str):
    import numpy as np

    inside = (wavelengths >= low) & (wavelengths <= high)
    if not inside.any():
        raise ValueError(f"no channel between {low} and {high}")
    own = y[:, inside]
    if stat == "median":
        return np.median(own, 1)
    if stat == "integral":
        return np.trapezoid(own, wavelengths[inside], axis=1)
    if stat == "trimmed_mean":
        cut = own.shape[1] // 10
        own = np.sort(own, 1)[:, cut : own.shape[1] - cut]
    return own.mean(1)


def _bounded(x, low: float, high: float, nan: float):
    import numpy as np

    return np.clip(np.nan_to_num(x, nan=nan, posinf=high, neginf=low), low, high)


def indicators_of(spectra, wavelengths, c: IndicatorConfig) -> dict:
    """Arrays of the eight indicators, by name."""
    import numpy as np

    n = len(wavelengths)
    y, _ = normalise(spectra, c.normalization)
    if c.smoothing == "savitzky_golay":
        y = y @ savgol_matrix(n, c.window, c.poly_order).T
    elif c.smoothing == "moving_average":
        y = y @ moving_average_matrix(n, c.window).T
    low, high, eps = c.clip
    out = {"clipping_fraction": ((y <= low + eps) | (y >= high - eps)).mean(1)}
    span = max(float(wavelengths[-1] - wavelengths[0]), c.eps)
    if c.baseline == "spline":
        fitted = y @ spline_smoother(n, (n / 8.0) ** 4).T
        t = np.linspace(-0.5, 0.5, n)
        slope = np.gradient(fitted, t, axis=1)[:, n // 2]
        bend = np.gradient(np.gradient(fitted, t, axis=1), t, axis=1)[:, n // 2] / 2
    else:
        inverse, design = poly_matrix(n, int(c.baseline[-1]))
        beta = huber_poly(y, design) if c.robust else y @ inverse.T
        fitted, slope, bend = beta @ design.T, beta[:, 1], beta[:, 2]
    scale = span if c.rescale else 1.0
    out["baseline_slope"], out["baseline_curvature"] = np.nan_to_num(slope / scale), np.nan_to_num(bend / scale**2)
    rest = y - fitted
    signal = np.median(y, 1) if c.signal_stat == "median" else y.mean(1)
    source = rest if c.snr_mode == "residual" else y - y @ moving_average_matrix(n, 5).T
    out["snr"] = _bounded(signal / (noise(source, c.noise_stat, c.eps) + c.eps), 0.0, c.snr_max, 0.0)
    for i, (top, bottom) in enumerate(c.bands, 1):
        ratio = band(y, wavelengths, *top, c.band_stat) / (band(y, wavelengths, *bottom, c.band_stat) + c.eps)
        out[f"band_ratio_{i}"] = _bounded(ratio, 0.0, c.ratio_max, 0.0)
    u = np.maximum(rest if c.entropy_residual else y, 0.0)
    if c.entropy_bins:
        u = np.stack([part.mean(1) for part in np.array_split(u, c.entropy_bins, axis=1)], 1)
    p = u / (u.sum(1, keepdims=True) + _EPS)
    out["spectral_entropy"] = _bounded(-(p * np.log(p + _EPS)).sum(1) / np.log(u.shape[1]), 0.0, 1.0, 0.0)
    return out


SCALARS = ("snr", "clipping_fraction", "baseline_slope", "baseline_curvature", "band_ratio_1", "band_ratio_2", "band_ratio_3", "spectral_entropy")


def indicators(df: DataFrame, config: IndicatorConfig | None = None, keep: tuple[str, ...] = ("sample_id", "sequence_id", "timestamp", "label")) -> DataFrame:
    """Eight scalars and the vector x of them for each spectrum; the grid is taken from the rows."""
    config = config or IndicatorConfig()
    kept = [k for k in keep if k in df.columns]
    shape = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in kept), *(f"{s} double" for s in SCALARS), "x array<double>"])

    def rows(batches):
        import numpy as np

        for b in batches:
            if not len(b):
                continue
            out = b[kept].copy()
            found = indicators_of(np.stack(b["spectrum"].to_numpy()), np.asarray(b["wavelengths"].iloc[0]), config)
            for s in SCALARS:
                out[s] = found[s]
            out["x"] = np.stack([found[s] for s in SCALARS], 1).tolist()
            yield out

    return map_slices(df.select(*kept, "spectrum", "wavelengths"), rows, shape)


def grid_hash(wavelengths) -> str:
    """SHA-256 of the grid as float64 bytes, little-endian."""
    import hashlib

    import numpy as np

    return hashlib.sha256(np.ascontiguousarray(wavelengths, "<f8").tobytes()).hexdigest()


def audited(df: DataFrame, config: IndicatorConfig | None = None) -> DataFrame:
    """sample_id and the audit texts of its indicators, as JSON: what was done before, the baseline, the bands, and the
    hash of the grid."""
    from pyspark.sql import functions as F

    config = config or IndicatorConfig()
    if config.baseline == "spline" or config.robust:
        raise ValueError("coefficients are audited for plain polynomials")

    def rows(batches):
        import json

        import numpy as np

        for b in batches:
            if not len(b):
                continue
            grid = np.asarray(b["wavelengths"].iloc[0])
            y, _ = normalise(np.stack(b["spectrum"].to_numpy()), config.normalization)
            if config.smoothing == "savitzky_golay":
                y = y @ savgol_matrix(len(grid), config.window, config.poly_order).T
            elif config.smoothing == "moving_average":
                y = y @ moving_average_matrix(len(grid), config.window).T
            inverse, _ = poly_matrix(len(grid), int(config.baseline[-1]))
            span = max(float(grid[-1] - grid[0]), config.eps) if config.rescale else 1.0
            ends = [[band(y, grid, *x, config.band_stat) for x in pair] for pair in config.bands]
            beta = y @ inverse.T
            yield b[["sample_id"]].assign(
                baseline_json=[json.dumps({"model": config.baseline, "coefficients": k.tolist(), "slope": k[1] / span, "curvature": k[2] / span**2}) for k in beta],
                bands_json=[json.dumps({f"ratio_{k}": {"numerator": float(t[i]), "denominator": float(d[i])} for k, (t, d) in enumerate(ends, 1)}) for i in range(len(b))],
                grid_hash=grid_hash(grid),
            )

    kind = df.schema["sample_id"].dataType.simpleString()
    out = df.select("sample_id", "spectrum", "wavelengths").mapInPandas(rows, f"sample_id {kind}, baseline_json string, bands_json string, grid_hash string")
    steps = F.to_json(F.struct(F.lit(config.normalization).alias("normalization"), F.lit(config.smoothing).alias("smoothing"), F.lit(list(config.clip)).alias("clipping")))
    return out.withColumn("steps_json", steps)


def peak_depth(spectra, wavelengths, peaks, core: float = 1.0, shoulder: float = 3.0):
    """Depth of the core of each peak under its shoulders, over a robust noise of the spectrum; summed up."""
    import numpy as np

    mad = np.maximum(1.4826 * np.median(np.abs(np.diff(spectra, axis=1) - np.median(np.diff(spectra, axis=1), 1, keepdims=True)), 1), _EPS)
    total = np.zeros(len(spectra))
    for centre, width in peaks:
        off = np.abs(wavelengths - centre)
        inner, outer = off <= core * width, (off > core * width) & (off <= shoulder * width)
        total += (spectra[:, outer].mean(1) - spectra[:, inner].mean(1)) / mad
    return total


def correlation_scores(spectra, template, degree: int = 2):
    """Correlation with the template of what a polynomial leaves of both."""
    import numpy as np

    inverse, design = poly_matrix(len(template), degree)
    rest = spectra - (spectra @ inverse.T) @ design.T
    own = template - design @ (inverse @ template)
    return rest @ own / np.maximum(np.linalg.norm(rest, axis=1) * np.linalg.norm(own), _EPS)


def scatter(df: DataFrame, column: str, fan: int = 32):
    """Count, sum and outer-product sum of a vector column. Every task sends one packed partial; `fan` nodes
    add those up, and the driver adds the nodes."""
    import numpy as np

    def packed(n, s, xx) -> bytes:
        return np.concatenate([[float(n)], s, xx.ravel()]).tobytes()

    def partial(batches):
        import pandas as pd
        from pyspark import TaskContext

        n, s, xx = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b[column].to_numpy()).astype(float)
                n, s, xx = n + len(x), s + x.sum(0), xx + x.T @ x
        if n:
            yield pd.DataFrame({"node": [TaskContext.get().partitionId() % fan], "sums": [packed(n, s, xx)]})

    def add(pdf):
        return pdf.head(1).assign(sums=[sum(np.frombuffer(x) for x in pdf["sums"]).tobytes()])

    shape = "node int, sums binary"
    nodes = map_slices(df.select(column), partial, shape).groupBy("node").applyInPandas(add, shape).orderBy("node").collect()
    if not nodes:
        raise ValueError("no rows to sum up")
    total = sum(np.frombuffer(r["sums"]) for r in nodes)
    size = int((np.sqrt(4 * len(total) - 3) - 1) / 2)  # 1 + size + size^2 numbers
    return int(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)


def whitened_filter(train: DataFrame, template, shrink: float = 0.1) -> dict:
    """Matched filter in the shrunk covariance of training spectra: mean and weights."""
    import numpy as np

    n, s, xx = scatter(train, "spectrum")
    mean = s / n
    cov = (xx - n * np.outer(mean, mean)) / max(n - 1, 1)
    cov = (1 - shrink) * cov + (shrink * np.trace(cov) / len(mean) + 1e-12) * np.eye(len(mean))
    w = np.linalg.solve(cov, template)
    return {"mean": mean.tolist(), "weights": (w / np.sqrt(template @ w)).tolist()}


def apply_filter(df: DataFrame, state: dict) -> DataFrame:
    """Score by a fitted filter, as an expression."""
    from pyspark.sql import functions as F

    centred = F.zip_with("spectrum", F.lit(state["mean"]), lambda x, m: x - m)
    total = F.aggregate(F.zip_with(centred, F.lit(state["weights"]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("filter_score", total)
