"""Multi-way decompositions: CP by alternating least squares over whole tables, joint unmixing under unknown
illumination, net analyte signal, self-calibration.

Over a table, the first mode is its rows. A row's own factor follows from the two small factors and the row, so it is
never stored: tasks make it, and what the other two factors need of all rows is a sum of rank x blocks x channels numbers
for each label. The driver holds those sums and the small factors, however many rows there are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unfold(t, mode: int):
    import numpy as np

    return np.moveaxis(t, mode, 0).reshape(t.shape[mode], -1)


def _khatri_rao(a, b):
    return (a[:, None, :] * b[None, :, :]).reshape(-1, a.shape[1])


def cp_als(t, rank: int, seed: int = 0, restarts: int = 3, steps: int = 200, nonnegative: bool = False, starts: list | None = None):
    """Best of several starts: (factors, relative error). starts: pairs of second and third factors to start from."""
    import numpy as np

    rng, best = np.random.default_rng(seed), (None, np.inf)
    size = max(float(np.linalg.norm(t)), 1e-300)
    for k in range(len(starts) if starts else restarts):
        f = [None, *(x.copy() for x in starts[k])] if starts else [np.abs(rng.normal(size=(n, rank))) for n in t.shape]
        last = np.inf
        for _ in range(steps):
            for mode in range(3):
                a, b = (f[m] for m in range(3) if m != mode)
                gram = (a.T @ a) * (b.T @ b) + 1e-10 * np.eye(rank)
                f[mode] = np.linalg.solve(gram, (_unfold(t, mode) @ _khatri_rao(a, b)).T).T
                if nonnegative:
                    f[mode] = np.maximum(f[mode], 1e-12)
            error = float(np.linalg.norm(t - np.einsum("ir,jr,kr->ijk", *f))) / size
            if last - error < 1e-9:
                break
            last = error
        if error < best[1]:
            best = ([x.copy() for x in f], error)
    return best


def joint_unmix(x, rank: int, seed: int = 0, steps: int = 100):
    """Rows of x as illumination (one curve) times mixtures of `rank` components, all non-negative:
    (illumination, weights, components, relative error)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    light, c = np.maximum(x.mean(0), 1e-9), np.abs(rng.normal(size=(rank, x.shape[1]))) + 0.1
    w = np.abs(rng.normal(size=(len(x), rank))) + 0.1
    for _ in range(steps):
        flat = x / light
        w *= np.maximum(flat @ c.T, 1e-12) / np.maximum(w @ c @ c.T, 1e-12)
        c *= np.maximum(w.T @ flat, 1e-12) / np.maximum(w.T @ w @ c, 1e-12)
        made = w @ c
        light = np.maximum((x * made).sum(0) / np.maximum((made * made).sum(0), 1e-12), 1e-9)
    return light, w, c, float(np.linalg.norm(x - light * (w @ c)) / np.linalg.norm(x))


def blank_basis(blanks, rank: int):
    """Leading directions of centred blank spectra."""
    import numpy as np

    return np.linalg.svd(blanks - blanks.mean(0), full_matrices=False)[2][:rank]


def net_analyte(spectrum, basis):
    """What is left of a spectrum outside the basis."""
    return spectrum - (spectrum @ basis.T) @ basis


def self_calibrate(t, degree: int = 3):
    """Divide out a gain common to all rows, the exponential of a polynomial in the channel, fitted to the mean log."""
    import numpy as np

    y = np.log(np.maximum(t, 1e-12)).mean(tuple(range(t.ndim - 1)))
    grid = np.linspace(-1, 1, t.shape[-1])
    gain = np.exp(np.polyval(np.polyfit(grid, y, degree), grid))
    return t / gain, gain


def _row_factors(x, second, third, nonnegative: bool):
    """The first factor for rows x of blocks x channels numbers, by the other two."""
    import numpy as np

    gram = (second.T @ second) * (third.T @ third) + 1e-10 * np.eye(second.shape[1])
    a = np.linalg.solve(gram, (x @ _khatri_rao(second, third)).T).T
    return np.maximum(a, 1e-12) if nonnegative else a


def _cp_sums(batches: Iterator, factors: dict, nonnegative: bool) -> Iterator:
    """For each label and start that is still moving: sums of a x row, of a x a, and of squares, over a task's rows."""
    import numpy as np
    import pandas as pd

    sums: dict = {}
    for pdf in batches:
        for label, rows in pdf.groupby("label", sort=False):
            x = np.stack(rows["x"].to_numpy()).astype(float)
            for k, (second, third) in factors.get(label, {}).items():
                a = _row_factors(x, second, third, nonnegative)
                own = np.concatenate([(a.T @ x).ravel(), (a.T @ a).ravel(), [(x * x).sum()]])
                sums[label, k] = sums.get((label, k), 0.0) + own
    yield pd.DataFrame([(label, k, s.tolist()) for (label, k), s in sums.items()], columns=["label", "start", "sums"])


def cp_fit(rows: DataFrame, blocks: int, channels: int, rank: int, seed: int = 0, restarts: int = 3, steps: int = 200, nonnegative: bool = True, tolerance: float = 1e-9) -> dict:
    """rows: label string, x array<double> of blocks x channels numbers. By label: (second factor, third factor, relative
    error), the best of several starts. A step of all labels and starts is one pass over the table; the labels are few."""
    import numpy as np

    rng = np.random.default_rng(seed)
    starts = [tuple(np.abs(rng.normal(size=(n, rank))) for n in (blocks, channels)) for _ in range(restarts)]
    labels = [r.label for r in rows.select("label").distinct().collect()]
    now = {label: {k: start for k, start in enumerate(starts)} for label in labels}
    best: dict = {label: (*starts[0], np.inf) for label in labels}
    last: dict = {}
    for _ in range(steps):
        if not any(now.values()):
            break
        parts = rows.mapInPandas(partial(_cp_sums, factors=now, nonnegative=nonnegative), "label string, start int, sums array<double>")
        total = parts.select("label", "start", F.posexplode("sums").alias("i", "s")).groupBy("label", "start", "i").agg(F.sum("s").alias("s"))
        found: dict = {}
        for r in total.collect():  # labels x starts x rank x (blocks x channels + rank) numbers
            found.setdefault((r.label, r.start), np.zeros(rank * blocks * channels + rank * rank + 1))[r.i] = r.s
        for (label, k), s in found.items():
            t, gram, squares = s[: -rank * rank - 1].reshape(rank, blocks, channels), s[-rank * rank - 1 : -1].reshape(rank, rank), s[-1]
            factors = list(now[label][k])
            for mode, other in ((0, 1), (1, 0)):
                seen = np.einsum("rjk,kr->jr" if mode == 0 else "rjk,jr->kr", t, factors[other])
                left = gram * (factors[other].T @ factors[other]) + 1e-10 * np.eye(rank)
                factors[mode] = np.linalg.solve(left, seen.T).T
                if nonnegative:
                    factors[mode] = np.maximum(factors[mode], 1e-12)
            second, third = factors
            inner = np.einsum("rjk,jr,kr->", t, second, third)
            model = (gram * (second.T @ second) * (third.T @ third)).sum()
            error = float(np.sqrt(max(squares - 2 * inner + model, 0.0) / max(squares, 1e-300)))
            if error < best[label][2]:
                best[label] = (second, third, error)
            if last.get((label, k), np.inf) - error < tolerance:
                del now[label][k]
            else:
                now[label][k], last[label, k] = (second, third), error
    return best


def _cp_rows(batches: Iterator, factors: dict, nonnegative: bool) -> Iterator:
    import numpy as np

    for pdf in batches:
        out = [None] * len(pdf)
        for label, at in pdf.groupby("label", sort=False).indices.items():
            a = _row_factors(np.stack(pdf["x"].to_numpy()[at]).astype(float), *factors[label][:2], nonnegative)
            for i, own in zip(at, a.tolist()):
                out[i] = own
        pdf["weights"] = out
        yield pdf


def cp_weights(rows: DataFrame, model: dict, nonnegative: bool = True) -> DataFrame:
    """rows with `weights`, the first factor of each by the fitted other two."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(partial(_cp_rows, factors=model, nonnegative=nonnegative), f"{kinds}, weights array<double>")


def self_calibrated(rows: DataFrame, vector: str, size: int, degree: int = 3) -> DataFrame:
    """rows with the vector divided by a gain common to all, the exponential of a polynomial in the channel that is fitted
    to the mean logarithms: one aggregation, then an expression."""
    import numpy as np

    parts = rows.select(F.posexplode(F.slice(vector, 1, size)).alias("i", "x"))
    mean = {r.i: r.y for r in parts.groupBy("i").agg(F.avg(F.ln(F.greatest(F.col("x").cast("double"), F.lit(1e-12)))).alias("y")).collect()}
    if len(mean) < size:
        return rows
    grid = np.linspace(-1, 1, size)
    gain = np.exp(np.polyval(np.polyfit(grid, [mean[i] for i in range(size)], degree), grid))
    return rows.withColumn(vector, F.zip_with(F.slice(vector, 1, size), F.lit(gain.tolist()), lambda x, g: x.cast("double") / g))
