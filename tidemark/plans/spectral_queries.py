"""Queries on spectra, with SQL twins: the vectors of `embeddings` as spectra on a grid of as many channels, so
they grow with the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import embed, spectra, tensor
from tidemark.plans.registry import query
from tidemark.sources import latents, simulate
from tidemark.sources.frames import read_table

CHANNELS = 64
GRID = np.linspace(900.0, 2500.0, CHANNELS)


def spectrum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectrum for each vector: half of one plus the value, so between 0 and 1 for nearly all."""
    spectrum = F.transform("embedding", lambda x: 0.5 + x.cast("double"))
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("sequence_id"), F.col("vec_id").cast("double").alias("timestamp"),
        F.when(F.col("label") < 3, "hazard").otherwise("benign").alias("label"), spectrum.alias("spectrum"), F.lit(GRID.tolist()).alias("wavelengths"),
    )


def _table(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + ")"


def _matrix(name: str, m) -> str:
    return _table(name, "i, j, w", [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]])


_RAW = "raw AS (SELECT vec_id AS sample_id, generate_subscripts(embedding, 1) - 1 AS i, 0.5 + unnest(embedding)::DOUBLE AS y FROM embeddings)"
_NORMED = _RAW + ", normed AS (SELECT sample_id, i, y / greatest(max(y) OVER (PARTITION BY sample_id), 1e-12) AS y FROM raw)"


@query(f"""WITH {_NORMED} SELECT sample_id, round(max(n.y), 9) AS top, round(sum(n.y), 6) AS total, round(sum(a.y), 9) AS area, max(raw.y) <= 1e-12 AS guarded
    FROM raw JOIN normed n USING (sample_id, i) JOIN (SELECT sample_id, i, y / greatest(sum(y) OVER (PARTITION BY sample_id), 1e-12) AS y FROM raw) a USING (sample_id, i) GROUP BY sample_id""")
def spectra_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the maximum and over the area; a spectrum without light is guarded."""
    shape = "sample_id long, top double, total double, area double, guarded boolean"

    def rows(batches):
        import pandas as pd

        for b in batches:
            y = np.stack(b["spectrum"].to_numpy()) if len(b) else np.zeros((0, CHANNELS))
            top, flag = spectra.normalise(y, "unit_max")
            area, _ = spectra.normalise(y, "unit_area")
            yield pd.DataFrame({"sample_id": b["sample_id"], "top": top.max(1), "total": top.sum(1), "area": area.sum(1), "guarded": flag})

    out = spectrum_rows(spark, sf_dir).select("sample_id", "spectrum").mapInPandas(rows, shape)
    return out.select("sample_id", F.round("top", 9).alias("top"), F.round("total", 6).alias("total"), F.round("area", 9).alias("area"), "guarded")


_SG, _MA5, _MA11 = spectra.savgol_matrix(CHANNELS, 11, 3), spectra.moving_average_matrix(CHANNELS, 5), spectra.moving_average_matrix(CHANNELS, 11)


@query(f"""WITH {_RAW}, {_matrix("sg", _SG)}, {_matrix("ma", _MA11)},
    s AS (SELECT sample_id, sg.i AS channel, sum(w * y) AS savgol FROM raw JOIN sg ON raw.i = sg.j GROUP BY ALL), m AS (SELECT sample_id, ma.i AS channel, sum(w * y) AS mean FROM raw JOIN ma ON raw.i = ma.j GROUP BY ALL)
    SELECT sample_id, CAST(channel AS INTEGER) AS channel, round(savgol, 6) AS savgol, round(mean, 6) AS mean FROM s JOIN m USING (sample_id, channel)""")
def spectra_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savitzky-Golay and moving average with their edges, channel by channel."""
    shape = "sample_id long, savgol array<double>, mean array<double>"

    def rows(batches):
        import pandas as pd

        for b in batches:
            y = np.stack(b["spectrum"].to_numpy()) if len(b) else np.zeros((0, CHANNELS))
            yield pd.DataFrame({"sample_id": b["sample_id"], "savgol": list(y @ _SG.T), "mean": list(y @ _MA11.T)})

    out = spectrum_rows(spark, sf_dir).select("sample_id", "spectrum").mapInPandas(rows, shape)
    each = out.select("sample_id", F.posexplode(F.arrays_zip("savgol", "mean")).alias("channel", "v"))
    return each.select("sample_id", "channel", F.round("v.savgol", 6).alias("savgol"), F.round("v.mean", 6).alias("mean"))


_INVERSE, _DESIGN = spectra.poly_matrix(CHANNELS, 2)
_SPAN = float(GRID[-1] - GRID[0])
_C = spectra.IndicatorConfig()


def _mean_of(low: float, high: float) -> str:
    held = np.flatnonzero((GRID >= low) & (GRID <= high))
    return f"avg(y) FILTER (i BETWEEN {held[0]} AND {held[-1]})"


_INDICATORS = f"""WITH {_NORMED}, {_matrix("sg", _SG)}, {_matrix("inv", _INVERSE)}, {_matrix("des", _DESIGN)},
    y AS (SELECT sample_id, sg.i AS i, sum(w * y) AS y FROM normed JOIN sg ON normed.i = sg.j GROUP BY ALL),
    beta AS (SELECT sample_id, inv.i AS k, sum(w * y) AS b FROM y JOIN inv ON y.i = inv.j GROUP BY ALL),
    fitted AS (SELECT sample_id, des.i AS i, sum(w * b) AS f FROM beta JOIN des ON beta.k = des.j GROUP BY ALL),
    rest AS (SELECT sample_id, i, y, y - f AS r FROM y JOIN fitted USING (sample_id, i)),
    mid AS (SELECT sample_id, median(r) AS m, median(y) AS signal FROM rest GROUP BY 1),
    mad AS (SELECT sample_id, any_value(signal) AS signal, 1.4826 * greatest(median(abs(r - m)), 1e-9) AS noise FROM rest JOIN mid USING (sample_id) GROUP BY 1),
    ent AS (SELECT sample_id, -sum(p * ln(p + 1e-12)) / ln({CHANNELS}) AS h FROM (SELECT sample_id, greatest(r, 0) / (sum(greatest(r, 0)) OVER (PARTITION BY sample_id) + 1e-12) AS p FROM rest) GROUP BY 1),
    bands AS (SELECT sample_id, avg(CASE WHEN y <= 1e-9 OR y >= 1 - 1e-9 THEN 1.0 ELSE 0.0 END) AS clipped,
      {", ".join(f"least(greatest({_mean_of(*t)} / ({_mean_of(*b)} + 1e-9), 0), 1e6) AS r{k}" for k, (t, b) in enumerate(_C.bands, 1))} FROM y GROUP BY 1)"""


@query(_INDICATORS + f"""SELECT sample_id, round(least(greatest(signal / (noise + 1e-9), 0), 1e6), 4) AS snr, round(clipped, 6) AS clipping_fraction,
    round(b1.b / {_SPAN!r} * 1e6, 4) AS slope_e6, round(b2.b / {_SPAN * _SPAN!r} * 1e9, 4) AS curvature_e9, round(r1, 6) AS band_ratio_1, round(r2, 6) AS band_ratio_2, round(r3, 6) AS band_ratio_3,
    round(least(greatest(h, 0), 1), 6) AS spectral_entropy FROM mad JOIN ent USING (sample_id) JOIN bands USING (sample_id)
    JOIN (SELECT * FROM beta WHERE k = 1) b1 USING (sample_id) JOIN (SELECT * FROM beta WHERE k = 2) b2 USING (sample_id)""")
def spectral_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight indicators of every spectrum under the default configuration."""
    out = spectra.indicators(spectrum_rows(spark, sf_dir))
    return out.select(
        "sample_id", F.round("snr", 4).alias("snr"), F.round("clipping_fraction", 6).alias("clipping_fraction"), F.round(F.col("baseline_slope") * 1e6, 4).alias("slope_e6"),
        F.round(F.col("baseline_curvature") * 1e9, 4).alias("curvature_e9"), *[F.round(c, 6).alias(c) for c in ("band_ratio_1", "band_ratio_2", "band_ratio_3", "spectral_entropy")],
    )


@query(_INDICATORS + f""" SELECT sample_id, round(b0.b, 6) AS level, round(b1.b / {_SPAN!r} * 1e6, 4) AS slope_e6, 'poly2' AS model FROM
    (SELECT * FROM beta WHERE k = 0) b0 JOIN (SELECT * FROM beta WHERE k = 1) b1 USING (sample_id)""")
def indicator_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit text of an indicator row says, read back from its JSON."""
    out = spectra.audited(spectrum_rows(spark, sf_dir))
    v = F.from_json("baseline_json", "struct<model: string, coefficients: array<double>, slope: double>")
    return out.select("sample_id", F.round(v["coefficients"][0], 6).alias("level"), F.round(v["slope"] * 1e6, 4).alias("slope_e6"), v["model"].alias("model"))


_OWN = np.flatnonzero((GRID >= 1200) & (GRID <= 1600))
_CUT = len(_OWN) // 10
_STEP = float(GRID[1] - GRID[0])


@query(f"""WITH {_RAW}, b AS (SELECT sample_id, i, y, row_number() OVER (PARTITION BY sample_id ORDER BY y) AS r, lead(y) OVER (PARTITION BY sample_id ORDER BY i) AS after FROM raw WHERE i BETWEEN {_OWN[0]} AND {_OWN[-1]})
    SELECT sample_id, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(sum((y + after) / 2) * {_STEP!r}, 4) AS integral, round(avg(y) FILTER (r > {_CUT} AND r <= {len(_OWN) - _CUT}), 6) AS trimmed FROM b GROUP BY 1""")
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, trapezoid area and trimmed mean of a window of the grid."""
    names = ("mean", "median", "integral", "trimmed_mean")

    def rows(batches):
        import pandas as pd

        for b in batches:
            y = np.stack(b["spectrum"].to_numpy()) if len(b) else np.zeros((0, CHANNELS))
            yield pd.DataFrame({"sample_id": b["sample_id"]} | {n.split("_")[0]: spectra.band(y, GRID, 1200, 1600, n) for n in names})

    out = spectrum_rows(spark, sf_dir).select("sample_id", "spectrum").mapInPandas(rows, "sample_id long, mean double, median double, integral double, trimmed double")
    return out.select("sample_id", *[F.round(c, d).alias(c) for c, d in (("mean", 6), ("median", 6), ("integral", 4), ("trimmed", 6))])


@query(f"""WITH {_NORMED}, {_matrix("ma", _MA5)}, {_matrix("poly", _DESIGN @ _INVERSE)}, sm AS (SELECT sample_id, ma.i AS i, sum(w * y) AS s FROM normed JOIN ma ON normed.i = ma.j GROUP BY ALL),
    high AS (SELECT sample_id, i, y, y - s AS r FROM normed JOIN sm USING (sample_id, i)), noise AS (SELECT sample_id, avg(y) AS signal, greatest(stddev_pop(r), 1e-9) AS noise FROM high GROUP BY 1),
    ent AS (SELECT sample_id, -sum(p * ln(p + 1e-12)) / ln(8) AS h FROM (SELECT sample_id, u / (sum(u) OVER (PARTITION BY sample_id) + 1e-12) AS p FROM (SELECT sample_id, i // 8 AS k, avg(greatest(y, 0)) AS u FROM normed GROUP BY ALL)) GROUP BY 1),
    base AS (SELECT sample_id, poly.i AS i, sum(w * y) AS f FROM normed JOIN poly ON normed.i = poly.j GROUP BY ALL)
    SELECT sample_id, round(least(signal / (noise + 1e-9), 1e6), 4) AS snr, round(h, 6) AS entropy FROM noise JOIN ent USING (sample_id)""")
def indicator_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other modes: no smoothing, noise as the deviation of what a moving average leaves, mean signal, entropy of
    eight bins of the spectrum itself."""
    c = spectra.IndicatorConfig(smoothing="none", snr_mode="high_frequency", noise_stat="std", signal_stat="mean", entropy_residual=False, entropy_bins=8)
    out = spectra.indicators(spectrum_rows(spark, sf_dir), c)
    return out.select("sample_id", F.round("snr", 4).alias("snr"), F.round("spectral_entropy", 6).alias("entropy"))


_HAT = spectra.spline_smoother(CHANNELS, (CHANNELS / 8.0) ** 4)
_T = np.linspace(-0.5, 0.5, CHANNELS)
_MID = CHANNELS // 2
#: Central differences at the middle channel, as rows over the channels.
_D1 = np.gradient(np.eye(CHANNELS), _T, axis=0)
_SLOPE, _BEND = (_D1 @ _HAT)[_MID], (_D1 @ _D1 @ _HAT)[_MID] / 2


@query(f"""WITH {_NORMED}, {_table("k", "i, s, b", [(i, float(_SLOPE[i]), float(_BEND[i])) for i in range(CHANNELS)])}
    SELECT sample_id, round(sum(s * y), 6) AS slope, round(sum(b * y), 5) AS curvature FROM normed JOIN k USING (i) GROUP BY 1""")
def spline_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and curvature of the penalised smoother in the middle of the grid, on the scaled axis."""
    c = spectra.IndicatorConfig(smoothing="none", baseline="spline", rescale=False)
    out = spectra.indicators(spectrum_rows(spark, sf_dir), c)
    return out.select("sample_id", F.round("baseline_slope", 6).alias("slope"), F.round("baseline_curvature", 5).alias("curvature"))


_PEAKS = ((1210.0, 60.0), (1725.0, 80.0))


def _depth(centre: float, width: float) -> str:
    off = np.abs(GRID - centre)
    inner, outer = np.flatnonzero(off <= width), np.flatnonzero((off > width) & (off <= 3 * width))
    return f"(avg(y) FILTER (i IN ({', '.join(map(str, outer))})) - avg(y) FILTER (i IN ({', '.join(map(str, inner))})))"


@query(f"""WITH {_RAW}, d AS (SELECT sample_id, i, y, lead(y) OVER (PARTITION BY sample_id ORDER BY i) - y AS step FROM raw), m AS (SELECT sample_id, median(step) AS m FROM d GROUP BY 1),
    n AS (SELECT sample_id, greatest(1.4826 * median(abs(step - m)), 1e-12) AS noise FROM d JOIN m USING (sample_id) GROUP BY 1)
    SELECT sample_id, round(({' + '.join(_depth(*p) for p in _PEAKS)}) / any_value(noise), 6) AS depth FROM d JOIN n USING (sample_id) GROUP BY 1""")
def peak_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of two peaks under their shoulders, over a robust noise."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            y = np.stack(b["spectrum"].to_numpy()) if len(b) else np.zeros((0, CHANNELS))
            yield pd.DataFrame({"sample_id": b["sample_id"], "depth": spectra.peak_depth(y, GRID, _PEAKS)})

    out = spectrum_rows(spark, sf_dir).select("sample_id", "spectrum").mapInPandas(rows, "sample_id long, depth double")
    return out.select("sample_id", F.round("depth", 6).alias("depth"))


_TEMPLATE = -simulate.library(GRID)[:2].sum(0)
_REST = np.eye(CHANNELS) - _DESIGN @ _INVERSE
_LEFT = _REST @ _TEMPLATE


@query(f"""WITH {_RAW}, {_matrix("m", _REST)}, {_table("t", "i, v", [(i, float(_LEFT[i])) for i in range(CHANNELS)])}, r AS (SELECT sample_id, m.i AS i, sum(w * y) AS r FROM raw JOIN m ON raw.i = m.j GROUP BY ALL)
    SELECT sample_id, round(sum(r * v) / greatest(sqrt(sum(r * r)) * {float(np.linalg.norm(_LEFT))!r}, 1e-12), 6) AS correlation FROM r JOIN t USING (i) GROUP BY 1""")
def template_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with a template of absorbers, a quadratic taken out of both."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            y = np.stack(b["spectrum"].to_numpy()) if len(b) else np.zeros((0, CHANNELS))
            yield pd.DataFrame({"sample_id": b["sample_id"], "correlation": spectra.correlation_scores(y, _TEMPLATE)})

    out = spectrum_rows(spark, sf_dir).select("sample_id", "spectrum").mapInPandas(rows, "sample_id long, correlation double")
    return out.select("sample_id", F.round("correlation", 6).alias("correlation"))


_SEEN = [0, 20, 41, 63]
_ROWS = simulate.library(GRID)
_KELVIN = 4500.0
_LIGHT = simulate.planck(GRID, _KELVIN)
_X = (GRID - GRID.mean()) / ((GRID[-1] - GRID[0]) / 2)
_KNOTS = np.linspace(GRID[0], GRID[-1], 3)


@query(f"""WITH c AS (SELECT s_suppkey, least(greatest(s_acctbal / 10000, 0.05), 1.0) AS conc, (s_suppkey % 7) / 10 AS a, (s_suppkey % 5) / 10 AS h, (s_suppkey % 40) AS angle, (s_suppkey % 3) / 100 AS o FROM supplier),
    {_table("g", "channel, light, x, ha, hb, wa, ba, u0, u1, u2", [(i, float(_LIGHT[i]), float(_X[i]), *[float(v) for v in _ROWS[:, i]], *[float(np.interp(GRID[i], _KNOTS, np.eye(3)[k])) for k in range(3)]) for i in _SEEN])}
    SELECT s_suppkey, channel, round(light * exp(-conc * (1 + 0.25 * h) * 1.025 / greatest(cos(radians(angle)), 0.2) * (a * ha + (0.9 - a) * wa + 0.1 * ba)) * (1 + u0 * o - u1 * o + u2 * 2 * o) * 0.9 + 0.03 + 0.002 * x - 0.001 * x * x, 6) AS y FROM c, g""")
def synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beer-Lambert spectra from latents in columns: illumination, mixture, path, sensor gain, baseline."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples():
                latents = {"path": 1.0, "humidity": r.h, "dust": 0.5, "angle": r.angle, "kelvin": _KELVIN, "concentration": r.conc, "offsets": [r.o, -r.o, 2 * r.o], "baseline": [0.03, 0.002, -0.001]}
                y = simulate.clean_spectrum(GRID, [r.a, 0.0, 0.9 - r.a, 0.1], latents)
                out += [(r.s_suppkey, i, float(y[i])) for i in _SEEN]
            yield pd.DataFrame(out, columns=["s_suppkey", "channel", "y"])

    k = F.col("s_suppkey")
    latents = read_table(spark, sf_dir, "supplier").select(
        k.cast("long").alias("s_suppkey"), F.least(F.greatest(F.col("s_acctbal") / 10000, F.lit(0.05)), F.lit(1.0)).cast("double").alias("conc"),
        (k % 7 / 10).cast("double").alias("a"), (k % 5 / 10).cast("double").alias("h"), (k % 40).cast("double").alias("angle"), (k % 3 / 100).cast("double").alias("o"),
    )
    return latents.mapInPandas(rows, "s_suppkey long, channel int, y double").select("s_suppkey", "channel", F.round("y", 6).alias("y"))


@query(f"""WITH {_RAW} SELECT count(*) AS n_rows, count(DISTINCT n) AS n_grids, bool_and(n = {CHANNELS}) AS full, '{spectra.grid_hash(GRID)}' AS grid_hash FROM (SELECT sample_id, count(*) AS n FROM raw GROUP BY 1)""")
def grid_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uniform grid in all rows, and its hash."""
    from tidemark.operators import contracts

    rows = contracts.require_one_grid(spectrum_rows(spark, sf_dir), "wavelengths")
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(F.size("wavelengths")).alias("n_grids"), F.bool_and(F.size("spectrum") == F.size("wavelengths")).alias("full"), F.lit(spectra.grid_hash(GRID)).alias("grid_hash"))


def _u(key: str, name: str) -> str:
    return f"(concat('0x', substr(sha256('7:' || {key} || '|{name}'), 1, 16))::UBIGINT / pow(2, 64))"


def _prior(key: str, name: str) -> str:
    p, u = latents.PRIORS[name], _u(key, name)
    if p["prior"] == "uniform":
        return f"({p['min']!r} + {u} * {p['max'] - p['min']!r})"
    if p["prior"] == "loguniform":
        return f"exp({float(np.log(p['min']))!r} + {u} * {float(np.log(p['max']) - np.log(p['min']))!r})"
    return f"({p['mean']!r} + {p['std']!r} * sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {_u(key, name + '~')}))"


_LATENTS = f"""k AS (SELECT DISTINCT 'seq_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS s FROM events),
    l AS (SELECT s, {", ".join(f"{_prior('s', n)} AS {n}" for n in latents.PRIORS)}, {_u("s", "hazard")} < 0.5 AS hazard, CASE WHEN {_u("s", "agent")} < 0.5 THEN 'hazard_a' ELSE 'hazard_b' END AS agent, 1 + floor({_u("s", "onset")} * 6) AS onset FROM k),
    e AS (SELECT *, 3 + floor({_u("s", "duration")} * (greatest(4, 10 - onset + 1) - 3)) AS duration FROM l),
    f AS (SELECT *, s || '_' || lpad(CAST(t AS VARCHAR), 3, '0') AS sample_id, hazard AND t >= onset AND t < onset + duration AS is_on FROM e, range(10) r(t))"""


def _latent_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read_table(spark, sf_dir, "events").select(F.concat(F.lit("seq_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("sequence_id")).distinct()
    return latents.frames_of(ids, 10, 7, episodes=True)


@query(f"""WITH {_LATENTS} SELECT sample_id, CASE WHEN is_on THEN 'hazard' ELSE 'benign' END AS label, CAST(onset AS INTEGER) AS onset, CAST(duration AS INTEGER) AS duration, round(path, 6) AS path, round(humidity + 0.02 * t, 6) AS humidity, round(dust + 0.01 * t, 6) AS dust,
    round(kelvin, 4) AS kelvin, round(concentration, 6) AS concentration, round(offset_3, 8) AS offset, round(tilt, 8) AS tilt, round(sigma, 8) AS sigma, CASE WHEN is_on AND share > (1 - share) * (1 - share) AND share > share * (1 - share) THEN agent WHEN 1 - share > share THEN 'water' ELSE 'background' END AS dominant FROM f""")
def generated_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latents of a simulated sequence for each user: priors, drift, hazard episodes, mixtures."""
    v = F.col("latents")
    return _latent_frames(spark, sf_dir).select(
        "sample_id", "label", "onset", "duration", F.round(v["path"], 6).alias("path"), F.round(v["humidity"], 6).alias("humidity"), F.round(v["dust"], 6).alias("dust"), F.round(v["kelvin"], 4).alias("kelvin"),
        F.round(v["concentration"], 6).alias("concentration"), F.round(v["offsets"][3], 8).alias("offset"), F.round(v["baseline"][1], 8).alias("tilt"), F.round("sigma", 8).alias("sigma"), F.col("mixture.components")[0].alias("dominant"),
    )


_POOL = ("amber", "birch", "cedar", "dogwood")


@query(f"""WITH c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s FROM customer), n AS (SELECT *, 2 + CAST(floor({_u("s", "components")} * 2) AS INTEGER) AS n FROM c),
    a AS ({" UNION ALL ".join(f"SELECT c_custkey, n, '{a}' AS agent, {_u('s', 'pick ' + a)} AS u, -ln(1 - {_u('s', 'weight ' + a)}) AS w FROM n" for a in _POOL)}),
    p AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY u) AS place FROM a), q AS (SELECT c_custkey, agent, w / sum(w) OVER (PARTITION BY c_custkey) AS w FROM p WHERE place <= n)
    SELECT c_custkey, string_agg(agent, '+' ORDER BY w DESC) AS components, round(max(w), 6) AS most FROM q GROUP BY 1""")
def generated_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three components without replacement, with weights uniform on the simplex."""
    m = latents.mixed(F.col("c_custkey").cast("string"), list(_POOL), 2, 3, 7)
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", m.alias("m"))
    return rows.select("c_custkey", F.array_join(F.map_keys("m"), "+").alias("components"), F.round(F.array_max(F.map_values("m")), 6).alias("most"))


_PIECES = [1.0, 2.0, 4.0]
_CURVE = np.interp(GRID, np.linspace(GRID[0], GRID[-1], 3), _PIECES)


@query(f"""WITH {_table("g", "channel, body, pieces", [(i, float(simulate.planck(GRID, 3000.0)[i]), float(_CURVE[i] / _CURVE.max())) for i in _SEEN])}
    SELECT n_nationkey, channel, round(CASE n_nationkey % 3 WHEN 0 THEN body WHEN 1 THEN pieces ELSE (channel + 1) / {CHANNELS} END, 6) AS light FROM nation, g""")
def illuminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Illumination by its kind: a black body, linear pieces over knots, or a fixed curve."""
    kinds = ({"kind": "blackbody", "kelvin": 3000.0}, {"kind": "piecewise", "values": _PIECES}, {"kind": "fixed", "values": list(range(1, CHANNELS + 1))})
    curves = [simulate.illumination(GRID, k) for k in kinds]
    rows = [(k, i, round(float(c[i]), 6)) for k, c in enumerate(curves) for i in _SEEN]
    known = spark.createDataFrame(rows, "kind int, channel int, light double")
    return read_table(spark, sf_dir, "nation").withColumn("kind", F.col("n_nationkey") % 3).join(F.broadcast(known), "kind").select("n_nationkey", "channel", "light")


@query(f"""WITH {_LATENTS}, d AS (SELECT sample_id, is_on, share, concentration * path * (1 + 0.25 * (humidity + 0.02 * t)) * (1 + 0.05 * (dust + 0.01 * t)) / greatest(cos(radians(angle)), 0.2) AS d FROM f)
    SELECT sample_id, round(d, 6) AS d_phys, round(d * CASE WHEN is_on THEN share ELSE 0 END, 6) AS tau_h FROM d""")
def d_phys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration times effective path from latents in JSON, and the hazards' share of it from the mixture in JSON."""
    from tidemark.functions.scalars import effective_path

    texts = _latent_frames(spark, sf_dir).select("sample_id", F.to_json("latents").alias("latent_json"), F.to_json("mixture").alias("mixture_json"))
    v = F.from_json("latent_json", "struct<path: double, humidity: double, dust: double, angle: double, concentration: double>")
    mix = F.from_json("mixture_json", "struct<components: array<string>, weights: array<double>>")
    share = F.aggregate(F.zip_with(mix["components"], mix["weights"], lambda c, w: F.when(c.isin(*latents.HAZARDS), w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    d = v["concentration"] * effective_path(v["path"], v["humidity"], v["dust"], v["angle"])
    return texts.select("sample_id", F.round(d, 6).alias("d_phys"), F.round(d * share, 6).alias("tau_h"))


_NET = embed.init(CHANNELS, 8, 4, 5)


@query(f"""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, (unnest(embedding)::DOUBLE - 0.01) / 0.2 AS x FROM embeddings), {_matrix("w0", _NET["W0"])}, {_matrix("w1", _NET["W1"])}, {_matrix("w2", _NET["W2"])},
    h0 AS (SELECT vec_id, j AS i, greatest(sum(x * w), 0) AS x FROM v JOIN w0 USING (i) GROUP BY ALL), h1 AS (SELECT vec_id, j AS i, greatest(sum(x * w), 0) AS x FROM h0 JOIN w1 USING (i) GROUP BY ALL),
    z AS (SELECT vec_id, j AS i, sum(x * w) AS x FROM h1 JOIN w2 USING (i) GROUP BY ALL) SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) AS z FROM z""")
def frozen_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by frozen weights and normalisation: three layers, unit length."""
    state = {"version": embed.VERSION, "mean": [0.01] * CHANNELS, "std": [0.2] * CHANNELS, "weights": {k: w.tolist() for k, w in _NET.items()}}
    out = embed.apply(read_table(spark, sf_dir, "embeddings"), "embedding", state, ["vec_id"])
    return out.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", "i", F.round("z", 6).alias("z"))


@query("""WITH e AS (SELECT vec_id, vec_id // 256 AS batch, label, label / 10 AS risk, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
    p AS (SELECT a.batch, a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, a.risk AS ra, b.risk AS rb, greatest(list_distance(a.x, b.x), 1e-6) AS d FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
    h AS (SELECT batch, a, any_value(ra) AS ra, max(d) FILTER (same) AS far, min(d) FILTER (NOT same) AS near, arg_min(rb, (d, b)) FILTER (NOT same) AS rn FROM p GROUP BY ALL),
    t AS (SELECT batch, coalesce(sum(greatest(far - near + 0.2 * (1 + abs(ra - rn)), 0)) FILTER (far IS NOT NULL AND near IS NOT NULL) / greatest(count(*) FILTER (far IS NOT NULL AND near IS NOT NULL), 1), 0) AS triplet FROM h GROUP BY 1),
    c AS (SELECT batch, sum(CASE WHEN same THEN d * d ELSE greatest(0.2 * (1 + abs(ra - rb)) - d, 0) ** 2 END) / count(*) AS contrastive FROM p GROUP BY 1)
    SELECT batch, round(triplet, 6) AS triplet, round(contrastive, 6) AS contrastive FROM t JOIN c USING (batch)""")
def metric_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplet loss of the hardest triples with a margin that grows with the gap in risk, and contrastive loss, by mini-batch."""

    def one(pdf):
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        z, y, risk = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy(), pdf["risk"].to_numpy()
        return pdf.head(1)[["batch"]].assign(triplet=embed.triplet(z, y, risk, 0.2)[0], contrastive=embed.contrastive(z, y, risk, 0.2)[0])

    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 256").alias("batch"), "label", (F.col("label") / 10).alias("risk"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    out = rows.groupBy("batch").applyInPandas(one, "batch long, triplet double, contrastive double")
    return out.select("batch", F.round("triplet", 6).alias("triplet"), F.round("contrastive", 6).alias("contrastive"))


_BLANK = np.linalg.qr(np.vander(np.linspace(-1, 1, CHANNELS), 4))[0].T


@query(f"""WITH {_RAW}, {_matrix("free", np.eye(CHANNELS) - _BLANK.T @ _BLANK)}, r AS (SELECT sample_id, free.i AS i, sum(w * y) AS r FROM raw JOIN free ON raw.i = free.j GROUP BY ALL)
    SELECT sample_id, round(sqrt(sum(r * r)), 6) AS left_over, round(max(r), 6) AS peak FROM r GROUP BY 1""")
def net_analyte_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a spectrum outside the subspace of blanks."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            r = [tensor.net_analyte(np.asarray(y), _BLANK) for y in b["spectrum"]]
            yield pd.DataFrame({"sample_id": b["sample_id"], "left_over": [float(np.linalg.norm(x)) for x in r], "peak": [float(x.max()) for x in r]})

    out = spectrum_rows(spark, sf_dir).select("sample_id", "spectrum").mapInPandas(rows, "sample_id long, left_over double, peak double")
    return out.select("sample_id", F.round("left_over", 6).alias("left_over"), F.round("peak", 6).alias("peak"))
