"""Simulated spectra: latents as expressions (`latents`), Beer-Lambert synthesis and noise in Arrow batches. The noise of a
frame comes from a generator seeded by its own name, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import padded, seed_for
from tidemark.sources import latents
from tidemark.sources.frames import map_slices
from tidemark.sources.latents import HAZARDS as HAZARDS

GRID = (900.0, 2500.0, 2.0)
#: Absorbers: centre, width and strength of each peak.
AGENTS = {
    "hazard_a": ((1210.0, 18.0, 0.9), (1725.0, 24.0, 0.6)),
    "hazard_b": ((1540.0, 20.0, 0.8), (2110.0, 30.0, 0.5)),
    "water": ((1450.0, 60.0, 0.7), (1940.0, 70.0, 0.9)),
    "background": ((1680.0, 120.0, 0.2),),
}


def grid():
    import numpy as np

    return np.arange(GRID[0], GRID[1] + GRID[2] / 2, GRID[2])


def library(wavelengths):
    """Absorption of each agent on the grid: a row per agent, in the order of AGENTS."""
    import numpy as np

    rows = []
    for peaks in AGENTS.values():
        rows.append(sum(a * np.exp(-0.5 * ((wavelengths - c) / w) ** 2) for c, w, a in peaks))
    return np.stack(rows)


def planck(wavelengths, kelvin: float):
    """Black-body curve over its peak on the grid."""
    import numpy as np

    m = wavelengths * 1e-9
    curve = 1 / (m**5 * np.expm1(0.014387768775039337 / (m * kelvin)))
    return curve / curve.max()


def baseline(wavelengths, a: float, b: float, c: float):
    x = (wavelengths - wavelengths.mean()) / ((wavelengths[-1] - wavelengths[0]) / 2)
    return a + b * x + c * x * x


def response(wavelengths, offsets):
    """Sensor gain: linear interpolation of offsets at evenly spaced knots, around one."""
    import numpy as np

    knots = np.linspace(wavelengths[0], wavelengths[-1], len(offsets))
    return 1 + np.interp(wavelengths, knots, offsets)


def clean_spectrum(wavelengths, weights, latents: dict):
    """Illumination times transmission through the mixture, on a sensor, over a baseline."""
    import numpy as np

    path = latents["path"] * (1 + 0.25 * latents["humidity"]) * (1 + 0.05 * latents["dust"]) / max(np.cos(np.radians(latents["angle"])), 0.2)
    absorbed = np.asarray(weights) @ library(wavelengths)
    light = planck(wavelengths, latents["kelvin"]) * np.exp(-latents["concentration"] * path * absorbed)
    return light * response(wavelengths, latents["offsets"]) * 0.9 + baseline(wavelengths, *latents["baseline"])


def add_noise(clean, sigma: float, alpha: float, rng, low: float = 0.0, high: float = 1.0):
    """Noise with a constant and a signal-dependent part, clipped; and the share that was."""
    import numpy as np

    noisy = clean + rng.normal(size=clean.shape) * np.sqrt(sigma**2 + alpha * np.maximum(clean, 0))
    return np.clip(noisy, low, high), float(np.mean((noisy <= low) | (noisy >= high)))


SCHEMA = (
    "sample_id string, sequence_id string, timestamp double, label string, wavelengths array<double>, spectrum array<double>, "
    "spectrum_clean array<double>, clipping_fraction double, agent_id string, latent_json string, mixture_json string"
)


def simulate(spark: SparkSession, sequences: int, frames: int = 10, seed: int = 7, episodes: bool = False, independent: bool = False) -> DataFrame:
    ids = spark.range(sequences).select(padded("seq_", F.col("id"), 6).alias("sequence_id"))
    return spectra_of(latents.frames_of(ids, frames, seed, episodes, independent), seed)


def spectra_of(frames: DataFrame, seed: int) -> DataFrame:
    """Spectra of frames with latents."""
    kept = ["sample_id", "sequence_id", "timestamp", "label"]
    rows = frames.select(*kept, "sigma", "latents", "amounts", F.col("mixture.components")[0].alias("agent_id"), F.to_json("latents").alias("latent_json"), F.to_json("mixture").alias("mixture_json"))

    def synthesised(batches):
        import numpy as np

        wavelengths = grid()
        for b in batches:
            out = b[[*kept, "agent_id", "latent_json", "mixture_json"]].copy()
            clean = [clean_spectrum(wavelengths, w, x if isinstance(x, dict) else x.asDict()) for w, x in zip(b["amounts"], b["latents"])]
            noisy = [add_noise(c, s, 1e-5, np.random.default_rng(seed_for(str(seed), i))) for c, s, i in zip(clean, b["sigma"], b["sample_id"])]
            out["wavelengths"] = [wavelengths] * len(b)
            out["spectrum"], out["spectrum_clean"] = [y for y, _ in noisy], clean
            out["clipping_fraction"] = [share for _, share in noisy]
            yield out[[c.split()[0] for c in SCHEMA.split(", ")]]

    return map_slices(rows, synthesised, SCHEMA)


def illumination(wavelengths, spec: dict):
    """Black body, linear pieces over even knots, or a fixed curve; pieces and curves over their peak."""
    import numpy as np

    if spec["kind"] == "blackbody":
        return planck(wavelengths, spec["kelvin"])
    values = np.asarray(spec["values"], float)
    curve = np.interp(wavelengths, np.linspace(wavelengths[0], wavelengths[-1], len(values)), values) if spec["kind"] == "piecewise" else values
    return curve / max(curve.max(), 1e-12)
