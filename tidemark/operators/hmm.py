"""Hidden Markov regimes: fit by EM over sequences, filter and smooth, persistence, grades.

The frames of a sequence meet in one array, once for all steps of a fit. Recursions run on NumPy in log space
over many sequences at a time, the longest first, so that those still running at a time are a prefix. EM sends
one row of sufficient statistics for each chunk of sequences to a sum; the driver holds parameters alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
VERSION = "hmm_params.v1"
STATES = ("trusted", "ambiguous", "degraded", "high_risk")


def _lse(a, axis=None):
    import numpy as np

    top = np.max(a, axis=axis, keepdims=True)
    out = top + np.log(np.sum(np.exp(a - top), axis=axis, keepdims=True))
    return out.squeeze(axis) if axis is not None else float(out.squeeze())


def _rows(m):
    return m / m.sum(axis=1, keepdims=True)


def banded(n: int, own: float, near: float, far: float, band: int | None = None):
    """Rows of weights by distance of states, shared among those at the distance; zero beyond the band."""
    import numpy as np

    d = np.abs(np.arange(n)[:, None] - np.arange(n))
    m = np.where(d == 0, own, 0.0)
    for which, mass in ((d == 1, near), (d > 1, far)):
        m += np.where(which, mass / np.maximum(which.sum(1, keepdims=True), 1), 0.0)
    if band is not None:
        m = np.where(d <= band, m, 0.0)
    return _rows(m)


def start(n: int = len(STATES), band: int | None = 1) -> dict:
    import numpy as np

    return {
        "version": VERSION, "band": band, "initial": np.full(n, 1 / n), "transition": banded(n, 0.90, 0.09, 0.01, band),
        "emission": _rows(np.clip(banded(n, 0.92, 0.07, 0.01), EPS, None)), "mean": None, "var": None,
    }


def dirichlet(n: int, own: float = 20.0, near: float = 2.0, far: float = 0.2):
    import numpy as np

    d = np.abs(np.arange(n)[:, None] - np.arange(n))
    return np.where(d == 0, own, np.where(d == 1, near, far))


#: Frames worked off at a time; a longer sequence is worked off alone.
CHUNK = 500_000


def log_emission(model: dict, obs, z=None):
    """Log likelihood of each frame in each state, from the discrete observation, the vector, or both."""
    import numpy as np

    out = np.zeros((len(obs), len(model["initial"])))
    if model["emission"] is not None:
        out += np.log(np.clip(model["emission"], EPS, None))[:, np.asarray(obs, int)].T
    if model["mean"] is not None and z is not None:
        var = np.clip(model["var"], EPS, None)
        gap = z[:, None, :] - model["mean"][None]
        out += -0.5 * (np.log(2 * np.pi * var).sum(1)[None] + (gap * gap / var[None]).sum(2))
    return out


class Chunk:
    """Sequences side by side. Frames of all of them stand one sequence behind the other, as they came."""

    def __init__(self, lengths) -> None:
        import numpy as np

        lengths = np.asarray(lengths)
        longest_first = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[longest_first]
        held = lengths[longest_first]
        #: Places of the frames at each time, of all sequences that are that long.
        self.at = [starts[: np.searchsorted(-held, -t, "left")] + t for t in range(int(held[0]) if len(held) else 0)]


def filtered(log_emit, model: dict, chunk: Chunk | None = None):
    """Filtered posterior in log space, and the log likelihood of each step. Without a chunk all frames are one
    sequence."""
    import numpy as np

    chunk = chunk or Chunk([len(log_emit)])
    a = np.log(np.clip(model["transition"], EPS, None))
    out, scale = np.empty_like(log_emit), np.empty(len(log_emit))
    for t, own in enumerate(chunk.at):
        if t:
            before = out[chunk.at[t - 1][: len(own)]]
            now = log_emit[own] + _lse(before[:, :, None] + a, axis=1)
        else:
            now = np.log(np.clip(model["initial"], EPS, None)) + log_emit[own]
        scale[own] = _lse(now, axis=1)
        out[own] = now - scale[own][:, None]
    return out, scale


def smoothed(log_emit, model: dict, chunk: Chunk | None = None):
    """Smoothed posterior, expected transitions, log likelihood, over all sequences of the chunk."""
    import numpy as np

    chunk = chunk or Chunk([len(log_emit)])
    a = np.log(np.clip(model["transition"], EPS, None))
    alpha, scale = filtered(log_emit, model, chunk)
    beta = np.zeros_like(alpha)
    moves = np.zeros_like(a)
    for t in range(len(chunk.at) - 2, -1, -1):
        after = chunk.at[t + 1]
        own = chunk.at[t][: len(after)]  # the others end here
        ahead = log_emit[after] + beta[after]
        beta[own] = _lse(a + ahead[:, None, :], axis=2) - scale[after][:, None]
        xi = alpha[own][:, :, None] + a + ahead[:, None, :]
        moves += np.exp(xi - _lse(xi.reshape(len(own), -1), axis=1)[:, None, None]).sum(0)
    gamma = alpha + beta
    return np.exp(gamma - _lse(gamma, axis=1)[:, None]), moves, float(scale.sum())


def sequences(frames: DataFrame) -> DataFrame:
    """One row for each sequence: its frames in order."""
    fields = ["timestamp", "sample_id", "obs", *(["z"] if "z" in frames.columns else [])]
    return frames.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("f"))


def _chunks(batches):
    """(rows of an Arrow batch, lengths, obs, z) of chunks of about CHUNK frames."""
    import numpy as np

    for b in batches:
        lengths = np.asarray(b.column("obs").value_lengths().to_numpy(zero_copy_only=False))
        cuts, size = [0], 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > CHUNK:
                cuts.append(i)
                size = 0
            size += n
        for i, j in zip(cuts, [*cuts[1:], len(lengths)]):
            own = b.slice(i, j - i)
            if own.num_rows:
                obs = own.column("obs").flatten().to_numpy(zero_copy_only=False)
                z = None
                if "z" in own.schema.names:
                    flat = own.column("z").flatten()
                    z = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(obs), -1)
                yield own, lengths[i:j], obs, z


def _parts(rows: DataFrame) -> DataFrame:
    return rows.select("sequence_id", *[F.col(f"f.{c}").alias(c) for c in rows.schema["f"].dataType.elementType.names])


def _statistics(rows: DataFrame, model: dict) -> dict:
    """Sums over all sequences of the sufficient statistics."""
    import numpy as np

    def some(batches):
        import pyarrow as pa

        for _, lengths, obs, z in _chunks(batches):
            chunk = Chunk(lengths)
            gamma, moves, ll = smoothed(log_emission(model, obs, z), model, chunk)
            n = gamma.shape[1]
            seen = np.stack([np.bincount(obs, weights=gamma[:, k], minlength=n) for k in range(n)])
            parts = [np.array([ll]), gamma[chunk.at[0]].sum(0), gamma.sum(0), moves.ravel(), seen.ravel()]
            if z is not None:
                parts += [(gamma.T @ z).ravel(), (gamma.T @ (z * z)).ravel()]
            flat = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    told = _parts(rows).drop("timestamp", "sample_id").mapInArrow(some, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat, n = np.array([r["v"] for r in told]), len(model["initial"])
    out, at = {}, 0
    d = (len(flat) - 1 - 2 * n - 2 * n * n) // (2 * n)
    for name, shape in (("ll", ()), ("first", (n,)), ("mass", (n,)), ("moves", (n, n)), ("seen", (n, n)), ("sum", (n, d)), ("squares", (n, d))):
        size = int(np.prod(shape)) if shape else 1
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fit(frames: DataFrame, iterations: int = 25, tolerance: float = 1e-4, floor: float = 1e-4, model: dict | None = None) -> tuple[dict, list[float]]:
    """EM over frames (sequence_id, timestamp, sample_id, obs[, z]); prior counts enter every step. Stops when
    the total log likelihood, measured after the update, moves by no more than the tolerance."""
    import numpy as np

    model = dict(model or start())
    n = len(model["initial"])
    frames = frames.persist()
    opening = frames.groupBy("sequence_id").agg(F.min_by("obs", F.struct("timestamp", "sample_id")).alias("obs")).groupBy("obs").count().collect()
    model["initial"] = np.array([sum(r["count"] for r in opening if r["obs"] == k) for k in range(n)], float)
    model["initial"] /= model["initial"].sum()
    if "z" in frames.columns:
        cells = frames.select("obs", F.posexplode("z").alias("i", "v"))
        rows = cells.groupBy("obs", "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()
        whole = cells.groupBy("i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("i").collect()
        model["mean"] = np.tile([r["m"] for r in whole], (n, 1))
        model["var"] = np.maximum(np.tile([r["s"] for r in whole], (n, 1)), floor)
        for r in rows:
            model["mean"][r["obs"], r["i"]], model["var"][r["obs"], r["i"]] = r["m"], max(r["s"], floor)
    rows = sequences(frames).persist()  # one exchange for all steps
    inside = np.abs(np.arange(n)[:, None] - np.arange(n)) <= (n if model["band"] is None else model["band"])
    history: list[float] = []
    stats = _statistics(rows, model)
    for _ in range(iterations):
        model["initial"] = stats["first"] / stats["first"].sum()
        model["transition"] = _rows(np.where(inside, stats["moves"] + dirichlet(n), 0.0))
        model["emission"] = _rows(stats["seen"] + start(n)["emission"])
        if model["mean"] is not None:
            for k in np.flatnonzero(stats["mass"] > EPS):
                model["mean"][k] = stats["sum"][k] / stats["mass"][k]
                model["var"][k] = np.maximum(stats["squares"][k] / stats["mass"][k] - model["mean"][k] ** 2, floor)
        stats = _statistics(rows, model)
        history.append(float(stats["ll"]))
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance:
            break
    rows.unpersist()
    frames.unpersist()
    return model, history


def infer(frames: DataFrame, model: dict, smoothing: bool = False) -> DataFrame:
    """p_state of every frame: filtered, or smoothed where asked for."""
    import numpy as np

    def some(batches):
        import pyarrow as pa

        for own, lengths, obs, z in _chunks(batches):
            log_emit, chunk = log_emission(model, obs, z), Chunk(lengths)
            p = smoothed(log_emit, model, chunk)[0] if smoothing else np.exp(filtered(log_emit, model, chunk)[0])
            n = p.shape[1]
            states = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, n, dtype=np.int32)), pa.array(p.ravel()))
            ids = own.column("sequence_id").take(pa.array(np.repeat(np.arange(own.num_rows), lengths)))
            yield pa.RecordBatch.from_arrays([ids, own.column("timestamp").flatten(), own.column("sample_id").flatten(), states], names=["sequence_id", "timestamp", "sample_id", "p_state"])

    return _parts(sequences(frames)).mapInArrow(some, "sequence_id string, timestamp double, sample_id string, p_state array<double>")


def log_likelihoods(frames: DataFrame, model: dict) -> DataFrame:
    """Log likelihood of each sequence under the model."""
    import numpy as np

    def some(batches):
        import pyarrow as pa

        for own, lengths, obs, z in _chunks(batches):
            steps = filtered(log_emission(model, obs, z), model, Chunk(lengths))[1]
            yield pa.RecordBatch.from_arrays([own.column("sequence_id"), pa.array(np.add.reduceat(steps, np.cumsum(lengths) - lengths))], names=["sequence_id", "log_likelihood"])

    return _parts(sequences(frames)).drop("timestamp", "sample_id").mapInArrow(some, "sequence_id string, log_likelihood double")


def exit_steps(model: dict, confirmable: list[int]):
    """Expected steps until the confirmable states are left; fails where they are never left."""
    import numpy as np

    q = np.asarray(model["transition"])[np.ix_(confirmable, confirmable)]
    if np.abs(np.linalg.eigvals(q)).max() >= 1:
        raise ValueError("confirmable states have no finite exit time")
    out = np.zeros(len(model["initial"]))
    out[confirmable] = np.maximum(np.linalg.solve(np.eye(len(q)) - q, np.ones(len(q))), 0)
    return out


def with_persistence(posterior: DataFrame, model: dict, confirmable: list[int], dt: float = 1.0) -> DataFrame:
    """p_confirmable, most likely state, persistence and grade, as expressions on p_state."""
    steps = exit_steps(model, confirmable).tolist()
    p = F.col("p_state")
    mass = sum((p[k] for k in confirmable[1:]), p[confirmable[0]])
    persistence = F.aggregate(F.zip_with(p, F.lit(steps), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = posterior.withColumns({
        "p_confirmable": mass, "state_mle": (F.array_position(p, F.array_max(p)) - 1).cast("int"),
        "persistence_steps": F.when(mass <= EPS, 0.0).otherwise(persistence),
        "state_expectation": F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x),
    })
    out = out.withColumn("persistence_seconds", F.col("persistence_steps") * dt)
    return out.withColumn("stability_grade", grade(F.col("p_confirmable"), F.col("persistence_seconds")))


def grade(p: Column, seconds: Column, rules=(("A", 0.95, 20.0), ("B", 0.85, 10.0), ("C", 0.70, 5.0))) -> Column:
    out = F.when((p >= rules[0][1]) & (seconds >= rules[0][2]), rules[0][0])
    for name, a, b in rules[1:]:
        out = out.when((p >= a) & (seconds >= b), name)
    return out.otherwise("D")


def priority(p: Column, seconds: Column) -> Column:
    return F.when((p >= 0.95) & (seconds >= 30.0), "HIGH").when((p >= 0.85) & (seconds >= 10.0), "MEDIUM").otherwise("LOW")


def policy_predicates(frames: DataFrame, max_entropy: float = 1.2) -> DataFrame:
    """veto, confirm_ok and rescan_ok for `folds.policy`, with the codes of vetoes."""
    from tidemark.functions.scalars import alert_token, entropy, finite

    s, p = F.col("persistence_seconds"), F.col("p_confirmable")
    bad = ~finite(s) | (s < 0)
    token = alert_token(F.coalesce("transition_alert", F.lit("")))
    blocked = token.isin("BOUNDARY_OSCILLATION", "DEGRADING_FAST")
    high = entropy(F.col("p_state")) > max_entropy
    return frames.withColumns({
        "veto": bad | high | blocked,
        "veto_codes": F.array_compact(F.array(
            F.when(bad, "SAFETY_VETO_INVALID_PERSISTENCE"), F.when(high, "SAFETY_VETO_HIGH_ENTROPY"), F.when(blocked, F.concat(F.lit("SAFETY_VETO_ALERT_"), token))
        )),
        "confirm_ok": (p >= 0.85) & (s >= 10.0) & F.col("stability_grade").isin("A", "B"),
        "rescan_ok": (p >= 0.60) & (s >= 2.0),
        "priority": priority(p, s),
    })


#: What a frozen model fixes for those who apply it.
RUNTIME = ("states", "confirmable", "ordering", "observations", "field", "dt_seconds", "include_smoothing")


def check_runtime(config: dict, frozen: dict) -> None:
    """The settings a model is applied with must be those it was frozen with, in kind and value. Both have the keys of
    RUNTIME; field matters where observations are continuous or hybrid."""
    import math

    if set(frozen) != set(RUNTIME):
        raise ValueError("a frozen model states exactly " + ", ".join(RUNTIME))
    dt, smoothing = frozen["dt_seconds"], frozen["include_smoothing"]
    if isinstance(dt, bool) or not isinstance(dt, (int, float)) or not math.isfinite(dt) or dt <= 0 or not isinstance(smoothing, bool):
        raise ValueError("dt_seconds must be a positive number and include_smoothing a boolean")
    asked = [k for k in RUNTIME if k != "field" or frozen["observations"] in ("continuous", "hybrid")]
    if differ := [k for k in asked if config.get(k) != frozen[k]]:
        raise ValueError("settings differ from the frozen model's: " + ", ".join(f"{k} {config.get(k)!r}, not {frozen[k]!r}" for k in differ))


def check_inputs(observations: str, field: str, embeddings: str | None, indicators: str | None) -> None:
    """Continuous and hybrid observations need the table that their vector is in."""
    needed = {"z": ("embeddings", embeddings), "x": ("indicators", indicators)}.get(field) if observations in ("continuous", "hybrid") else None
    if needed and needed[1] is None:
        raise ValueError(f"{observations} observations of {field} need the table of {needed[0]}")


def dump(model: dict) -> str:
    plain = {k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in model.items()}
    return json.dumps(plain, sort_keys=True, separators=(",", ":"), allow_nan=False)


def load(text: str) -> dict:
    """A frozen model, checked: known version, rows that are distributions."""
    import numpy as np

    m = json.loads(text)
    if m.get("version") != VERSION:
        raise ValueError(f"unknown version {m.get('version')!r}")
    for name in ("initial", "transition", "emission", "mean", "var"):
        m[name] = None if m[name] is None else np.asarray(m[name], float)
    for name in ("initial", "transition", "emission"):
        if m[name] is not None and (not np.isfinite(m[name]).all() or (m[name] < 0).any() or not np.allclose(m[name].sum(-1), 1, atol=1e-6)):
            raise ValueError(f"{name} is not a distribution")
    return m
