"""Identifiability probes over grids: a row per (condition, family), worked off where it lies, then aggregated.

A family is a set of spectra made of two analytes over a background that varies; a probe asks how well the
ratio of the analytes, or the presence of one, is recovered under a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import seed_for
from tidemark.plans.audit import first_dose

CHANNELS = 64


def _shapes():
    import numpy as np

    x = np.linspace(0, 1, CHANNELS)
    peak = lambda c, w: np.exp(-0.5 * ((x - c) / w) ** 2)
    return peak(0.35, 0.05), peak(0.6, 0.06), np.stack([np.ones_like(x), x, peak(0.5, 0.2), peak(0.8, 0.1)])


def family(seed: int, name: str, ratio: float, dose: float, sigma: float, gain: float, n: int = 12):
    """n spectra with the first analyte at dose * ratio and the second at dose, a varying background, noise of
    sigma, and a gain error that is the same for the whole family."""
    import numpy as np

    a, b, back = _shapes()
    rng = np.random.default_rng(seed_for(str(seed), name))
    bend = 1 + gain * rng.normal() * np.sin(np.linspace(0, np.pi, CHANNELS)) + gain * rng.normal() * np.linspace(-1, 1, CHANNELS)
    rows = dose * (ratio * a + b) + rng.uniform(0.3, 1.0, size=(n, len(back))) @ back
    return rows * bend + sigma * rng.normal(size=rows.shape)


def read_amounts(spectra) -> tuple[float, float]:
    """Amounts of both analytes in the mean spectrum from least squares, with the background projected out."""
    import numpy as np

    a, b, back = _shapes()
    beta = np.linalg.lstsq(np.stack([a, b, *back], 1), spectra.mean(0), rcond=None)[0]
    return float(beta[0]), float(beta[1])


def read_ratio(spectra) -> float:
    """Ratio of the analytes; NaN where the second is absent."""
    first, second = read_amounts(spectra)
    return first / second if abs(second) > 1e-9 else float("nan")


def detector_scores(spectra, blanks) -> dict[str, float]:
    """Evidence of the first analyte by four detectors: known background, net analyte signal against blanks, plain
    correlation, single channel."""
    import numpy as np

    from tidemark.operators.tensor import blank_basis, net_analyte

    a, b, back = _shapes()
    y = spectra.mean(0)
    known = np.linalg.lstsq(np.stack([a, b, *back], 1), y, rcond=None)[0][0]
    basis = blank_basis(blanks, 3)
    centred, own = net_analyte(y - blanks.mean(0), basis), net_analyte(a, basis)
    return {"oracle": float(known), "net_analyte": float(centred @ own / (own @ own)), "correlation": float(np.corrcoef(y, a)[0, 1]), "channel": float(y[int(a.argmax())])}


def _grid(spark: SparkSession, columns: str, rows: list[tuple], families: int) -> DataFrame:
    return spark.createDataFrame(rows, columns).withColumn("family", F.explode(F.sequence(F.lit(0), F.lit(families - 1))))


def recovery(spark: SparkSession, sigmas: list[float], gains: list[float], families: int = 60, seed: int = 1) -> DataFrame:
    """Slope and RMSE of the read ratio against the true one, and invalid reads, for each noise and gain error."""

    def run(batches):
        import numpy as np

        for p in batches:
            names = [f"{f}" for f in p["family"]]
            truth = [float(np.random.default_rng(seed_for(str(seed), f"ratio|{n}")).uniform(0.5, 2.0)) for n in names]
            p["truth"] = truth
            p["read"] = [read_ratio(family(seed, n, r, 1.0, s, g)) for n, r, s, g in zip(names, truth, p["sigma"], p["gain"])]
            yield p

    grid = _grid(spark, "sigma double, gain double", [(s, g) for s in sigmas for g in gains], families)
    rows = grid.mapInPandas(run, "sigma double, gain double, family int, truth double, read double")
    return calibrated(rows, ["sigma", "gain"])


def calibrated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Slope of what was read against the truth, RMSE, and reads that are not valid (NaN)."""
    good = ~F.isnan("read") & F.col("read").isNotNull()
    gap = F.when(good, F.col("read") - F.col("truth"))
    return rows.groupBy(*by).agg(
        F.regr_slope(F.when(good, F.col("read")), F.when(good, F.col("truth"))).alias("slope"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count_if(~good).alias("invalid"), F.count("*").alias("n")
    )


def tolerance(recovered: DataFrame, limit: float = 0.30) -> DataFrame:
    """Largest gain error at which the RMSE is within the limit, for each noise."""
    return recovered.groupBy("sigma").agg(F.max(F.when(F.col("rmse") <= limit, F.col("gain"))).alias("tolerated_gain"))


def detection_power(spark: SparkSession, doses: list[float], families: int = 100, alpha: float = 0.05, sigma: float = 0.05, seed: int = 2) -> DataFrame:
    """Share of families at each dose whose score exceeds the detector's own 1 - alpha quantile at dose zero."""

    def run(batches):
        import pandas as pd

        for p in batches:
            out = []
            for dose, f in zip(p["dose"], p["family"]):
                spectra, blanks = family(seed, f"{dose}|{f}", dose, 1.0, sigma, 0.01), family(seed, f"blank|{f}", 0.0, 1.0, sigma, 0.01, 24)
                out += [(dose, f, d, s) for d, s in detector_scores(spectra, blanks).items()]
            yield pd.DataFrame(out, columns=["dose", "family", "detector", "score"])

    grid = _grid(spark, "dose double", [(float(d),) for d in sorted({0.0, *doses})], families)
    rows = grid.mapInPandas(run, "dose double, family int, detector string, score double")
    return power_curve(rows, alpha)


def power_curve(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of scores (detector, dose, score) at each dose above the detector's own 1 - alpha quantile at dose zero."""
    cut = rows.filter("dose = 0").groupBy("detector").agg(F.percentile("score", 1 - alpha).alias("cut"))
    return rows.filter("dose > 0").join(F.broadcast(cut), "detector").groupBy("detector", "dose").agg(F.avg((F.col("score") > F.col("cut")).cast("double")).alias("power"))


def detection_limit(power: DataFrame, target: float = 0.95) -> DataFrame:
    return first_dose(power, target)
