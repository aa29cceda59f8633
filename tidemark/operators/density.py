"""Sequence densities: two-component mixtures and hidden chains over vectors, and log likelihood ratios.

Also logistic regression and what single-vector probes need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.frames import materialize


def two_means(x, seed: int, starts: int = 8, steps: int = 100):
    """Lloyd's algorithm for two centres from several starts; labels of the best."""
    import numpy as np

    rng, best, best_cost = np.random.default_rng(seed), None, np.inf
    for _ in range(starts):
        c = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(steps):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            y = d.argmin(1)
            new = np.stack([x[y == k].mean(0) if (y == k).any() else c[k] for k in (0, 1)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best_cost:
            best, best_cost = y, cost
    return best


def fit_chain(sequences: list, seed: int, hidden: bool, steps: int = 50, floor: float = 1e-3) -> dict:
    """EM of a two-component Gaussian mixture over frames, or of a chain over them where hidden."""
    import numpy as np

    from tidemark.operators.hmm import log_emission, smoothed

    x = np.concatenate(sequences)
    y = two_means(x, seed)
    mean = np.stack([x[y == k].mean(0) for k in (0, 1)])
    var = np.stack([np.maximum(x[y == k].var(0), floor) for k in (0, 1)])
    share = np.clip(np.bincount(y, minlength=2) / len(y), 0.05, 0.95)
    model = {"initial": share / share.sum(), "transition": np.array([[0.9, 0.1], [0.1, 0.9]]) if hidden else np.tile(share / share.sum(), (2, 1)), "emission": None, "mean": mean, "var": var}
    last = -np.inf
    for _ in range(steps):
        first, moves, mass, s, ss, ll = np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.zeros_like(mean), np.zeros_like(mean), 0.0
        for seq in sequences:
            gamma, xi, l = smoothed(log_emission(model, np.zeros(len(seq)), seq), model)
            first, moves, mass, ll = first + gamma[0], moves + xi, mass + gamma.sum(0), ll + l
            s, ss = s + gamma.T @ seq, ss + gamma.T @ (seq * seq)
        model = dict(model)
        if hidden:
            model["initial"], model["transition"] = (first + 1) / (first + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True)
        else:
            model["initial"] = mass / mass.sum()
            model["transition"] = np.tile(model["initial"], (2, 1))
        model["mean"] = s / mass[:, None]
        model["var"] = np.maximum(ss / mass[:, None] - model["mean"] ** 2, floor)
        if abs(ll - last) < 1e-6 * max(1, abs(ll)):
            break
        last = ll
    return model


#: Frames on which the first two centres are sought, the least by a digest of their ids.
FIRST = 20_000


def _one_side(sides, side, lengths, z):
    """Lengths and frames of the sequences of one side."""
    import numpy as np

    own = sides == side
    return lengths[own], z[np.repeat(own, lengths)]


def _sums(model: dict, hidden: bool, lengths, z):
    """Sufficient statistics of sequences side by side, flat: log likelihood, openings, mass, moves, sums, squares. A
    mixture's frames don't depend on one another, so it needs no recursion."""
    import numpy as np

    from tidemark.operators.hmm import EPS, Chunk, _lse, log_emission, smoothed

    emit = log_emission(model, np.zeros(len(z), np.int8), z)
    if hidden:
        chunk = Chunk(lengths)
        gamma, moves, ll = smoothed(emit, model, chunk)
        first = gamma[chunk.at[0]].sum(0)
    else:
        joint = emit + np.log(np.clip(model["initial"], EPS, None))
        scale = _lse(joint, axis=1)
        gamma, moves, first, ll = np.exp(joint - scale[:, None]), np.zeros((2, 2)), np.zeros(2), scale.sum()
    return np.concatenate([[ll], first, gamma.sum(0), moves.ravel(), (gamma.T @ z).ravel(), (gamma.T @ (z * z)).ravel()])


def _step_sums(rows: DataFrame, models: dict, arms: dict[str, bool]) -> dict:
    """Sums of the statistics of all models over all their sequences, in one pass; a task sends one row of each number."""
    import numpy as np

    from tidemark.operators.hmm import _chunks

    keys = list(models)

    def some(batches):
        import pyarrow as pa

        total = {}
        for own, lengths, _, z in _chunks(batches):
            sides = own.column("side").to_numpy(zero_copy_only=False)
            for k, (arm, side) in enumerate(keys):
                mine, points = _one_side(sides, side, lengths, z)
                if len(mine):
                    total[k] = total.get(k, 0.0) + _sums(models[arm, side], arms[arm], mine, points)
        for k, flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "i", "v"])

    told = rows.mapInArrow(some, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    flat = {k: [] for k in range(len(keys))}
    for r in sorted(told):
        flat[r["k"]].append(r["v"])
    out = {}
    for k, key in enumerate(keys):
        x = np.array(flat[k])
        out[key] = {"ll": x[0], "first": x[1:3], "mass": x[3:5], "moves": x[5:9].reshape(2, 2), "sum": x[9 : 9 + (len(x) - 9) // 2].reshape(2, -1), "squares": x[9 + (len(x) - 9) // 2 :].reshape(2, -1)}
    return out


def fit_sides(frames: DataFrame, seed: int, arms: dict[str, bool], steps: int = 50, floor: float = 1e-3) -> dict[tuple[str, int], dict]:
    """The same fits to the frames (side int, sequence_id, timestamp, sample_id, z) of each side of a table of any size: a
    chain where the arm's value says hidden, else a mixture. Each step is one pass for all models that still move. Only
    the first centres come from a bounded sample."""
    import numpy as np

    models = {}
    packed = frames.groupBy("side", "sequence_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "sample_id", F.lit(0).alias("obs"), "z"))).alias("f"))
    rows = materialize(packed.select("side", F.col("f.obs").alias("obs"), F.col("f.z").alias("z")), "sides")
    for side in sorted(r["side"] for r in rows.select("side").distinct().collect()):
        opening = frames.filter(F.col("side") == side).orderBy(F.sha2(F.col("sample_id").cast("string"), 256), "sample_id").limit(FIRST).select("z").collect()
        x = np.array([r["z"] for r in opening], float)
        y = two_means(x, seed)
        share = np.clip(np.bincount(y, minlength=2) / len(y), 0.05, 0.95)
        share = share / share.sum()
        for arm, hidden in arms.items():
            models[arm, side] = {
                "initial": share, "transition": np.array([[0.9, 0.1], [0.1, 0.9]]) if hidden else np.tile(share, (2, 1)), "emission": None,
                "mean": np.stack([x[y == k].mean(0) for k in (0, 1)]), "var": np.stack([np.maximum(x[y == k].var(0), floor) for k in (0, 1)]),
            }
    last = dict.fromkeys(models, -np.inf)
    for _ in range(steps):
        moving = {key: models[key] for key in last}
        if not moving:
            break
        for key, s in _step_sums(rows, moving, arms).items():
            hidden = arms[key[0]]
            initial = (s["first"] + 1) / (s["first"] + 1).sum() if hidden else s["mass"] / s["mass"].sum()
            transition = (s["moves"] + 1) / (s["moves"] + 1).sum(1, keepdims=True) if hidden else np.tile(initial, (2, 1))
            mean = s["sum"] / s["mass"][:, None]
            models[key] = models[key] | {"initial": initial, "transition": transition, "mean": mean, "var": np.maximum(s["squares"] / s["mass"][:, None] - mean**2, floor)}
            if abs(s["ll"] - last[key]) < 1e-6 * max(1, abs(s["ll"])):
                del last[key]
            else:
                last[key] = float(s["ll"])
    return models


def fit_frames(frames: DataFrame, seed: int, hidden: bool, steps: int = 50, floor: float = 1e-3) -> dict:
    """The fit to one table of frames (sequence_id, timestamp, sample_id, z)."""
    return fit_sides(frames.withColumn("side", F.lit(0)), seed, {"": hidden}, steps, floor)["", 0]


def chain_likelihood(df: DataFrame, models: dict[str, tuple[dict, dict]]) -> DataFrame:
    """Per sequence and arm, log likelihood under the hazard model less that under the benign one, per frame.
    df: sequence_id, timestamp, sample_id, z."""
    import numpy as np

    from tidemark.operators.hmm import Chunk, _chunks, _parts, filtered, log_emission, sequences

    def some(batches):
        import pyarrow as pa

        for own, lengths, obs, z in _chunks(batches):
            chunk, ends = Chunk(lengths), np.cumsum(lengths)
            for arm, pair in models.items():
                steps = [filtered(log_emission(m, obs, z), m, chunk)[1] for m in pair]
                gap = np.add.reduceat(steps[0] - steps[1], ends - lengths) / lengths
                yield pa.RecordBatch.from_arrays([own.column("sequence_id"), pa.array([arm] * own.num_rows), pa.array(gap)], names=["sequence_id", "arm", "llr"])

    rows = _parts(sequences(df.withColumn("obs", F.lit(0)))).select("sequence_id", "obs", "z")
    return rows.mapInArrow(some, "sequence_id string, arm string, llr double")


def logistic(df: DataFrame, vector: str, label: str, c: float = 1.0):
    """Ridge logistic regression: strength 1 / (c n), without standardisation. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(regParam=1 / (c * rows.count()), standardization=False, maxIter=200, tol=1e-9).fit(rows)


def logistic_scores(df: DataFrame, vector: str, model, keep: list[str]) -> DataFrame:
    """Probability by a fitted model, as an expression on its coefficients."""
    weights, bias = [float(x) for x in model.coefficients], float(model.intercept)
    total = F.aggregate(F.zip_with(vector, F.lit(weights), lambda x, w: x.cast("double") * w), F.lit(bias), lambda a, x: a + x)
    return df.select(*keep, (1 / (1 + F.exp(-total))).alias("score"))


#: Points of a cloud that go out at once, and rows whose distances to them are held at once.
CLOUD = 20_000
ROWS = 256


def _to_block(block: int, points: list, names: list, has_label):
    """mapInPandas function: each row's sums of distances to a block of points, by label of the points."""
    import numpy as np

    x = np.array([p[0] for p in points] or np.zeros((0, 1)), float)
    own_label = np.zeros((len(points), len(names)))
    own_label[np.arange(len(points)), [has_label[p[1]] for p in points]] = 1
    square = (x**2).sum(1)

    def rows(batches):
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            own, sums = np.stack(b["vector"].to_numpy()).astype(float), np.empty((len(b), len(names)))
            for i in range(0, len(b), ROWS):
                part = own[i : i + ROWS]
                sums[i : i + ROWS] = np.sqrt(np.maximum((part**2).sum(1)[:, None] + square - 2 * part @ x.T, 0)) @ own_label
            yield pd.DataFrame({"key": b["key"], "label": b["label"], "h": b["h"], "g": b["g"], "block": np.int32(block), "sums": list(sums)})

    return rows


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Mean silhouette by Euclidean distance, over all pairs. The cloud goes out in blocks of CLOUD points, and each row's
    sums of distances by label add up over the blocks, so time grows with the square of the rows and memory does not.
    Equal rows stand for one another while sums add up, and count as often as they are there."""
    import numpy as np

    kinds = {n: df.schema[c].dataType.simpleString() for n, c in (("key", key), ("label", label))}
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    names = sorted(sizes)
    has_label, n = {v: i for i, v in enumerate(names)}, np.array([sizes[v] for v in names])
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.xxhash64(vector).alias("h"), F.hash(vector).alias("g"))
    shape = f"key {kinds['key']}, label {kinds['label']}, h long, g int, block int, sums array<double>"
    met, blocks, points = None, 0, []

    def meet():
        one = rows.mapInPandas(_to_block(blocks, points, names, has_label), shape)
        return one if met is None else met.unionAll(one)

    for p in df.select(vector, label).toLocalIterator():
        points.append(p)
        if len(points) == CLOUD:
            met, blocks, points = meet(), blocks + 1, []
    if points or not blocks:
        met, blocks = meet(), blocks + 1
    if blocks > 1:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "sums"))), lambda p: p["sums"])
        added = met.groupBy("key", "label", "h", "g").agg(parts.alias("parts"))
        added = added.withColumn("copies", F.expr(f"size(parts) div {blocks}").cast("int"))
        zero = F.array_repeat(F.lit(0.0), len(names))
        total = F.aggregate("parts", zero, lambda a, p: F.zip_with(a, p, lambda u, v: u + v))
        added = added.select("key", "label", "copies", total.alias("sums"))
        met = added.select("key", "label", F.transform("sums", lambda u: u / F.col("copies")).alias("sums"), F.explode(F.sequence(F.lit(1), "copies")))

    def scores(batches):
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            sums, k = np.stack(b["sums"].to_numpy()), np.array([has_label[v] for v in b["label"]])
            i = np.arange(len(k))
            a = np.where(n[k] > 1, sums[i, k] / np.maximum(n[k] - 1, 1), 0.0)
            means = sums / n
            means[i, k] = np.inf
            other = means.min(1)
            yield pd.DataFrame({key: b["key"], "silhouette": np.where(n[k] > 1, (other - a) / np.maximum(np.maximum(a, other), 1e-300), 0.0)})

    return met.select("key", "label", "sums").mapInPandas(scores, f"{key} {kinds['key']}, silhouette double")
