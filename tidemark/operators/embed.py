"""Embeddings: a three-layer network trained on a bounded sample (`fit`) or on all rows (`fit_all`), applied from frozen
weights.

Loss: cross-entropy of a linear head on the embedding, squared error of a risk head, and a metric loss
(triplets with a margin that grows with the gap in risk, or contrastive pairs). Gradients are by hand."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.frames import scratch

VERSION = "embedding_weights.v1"
WIDTHS = (32, 16)


def init(size: int, out: int, classes: int, seed: int) -> dict:
    import numpy as np

    rng, w = np.random.default_rng(seed), {}
    for k, (a, b) in enumerate(zip((size, *WIDTHS), (*WIDTHS, out))):
        w[f"W{k}"], w[f"b{k}"] = rng.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b)
    w["Wc"], w["bc"] = rng.normal(size=(out, classes)) * np.sqrt(1 / out), np.zeros(classes)
    w["Wr"], w["br"] = rng.normal(size=(out, 1)) * np.sqrt(1 / out), np.zeros(1)
    return w


def forward(w: dict, x, unit: bool = True):
    """Embedding and what the backward pass needs."""
    import numpy as np

    h0 = np.maximum(x @ w["W0"] + w["b0"], 0)
    h1 = np.maximum(h0 @ w["W1"] + w["b1"], 0)
    raw = h1 @ w["W2"] + w["b2"]
    norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12) if unit else np.ones((len(x), 1))
    return raw / norm, (x, h0, h1, norm, unit)


def triplet(z, y, risk, margin: float):
    """Mean hinge over anchors of the hardest other-class point against the farthest own-class one; the margin
    grows with the gap in risk. Value and gradient."""
    import numpy as np

    d = np.sqrt(np.maximum(((z[:, None] - z[None]) ** 2).sum(2), 1e-12))
    same = y[:, None] == y[None]
    own, other = np.where(same, d, -np.inf), np.where(same, np.inf, d)
    np.fill_diagonal(own, -np.inf)
    use = np.isfinite(own.max(1)) & np.isfinite(other.min(1))
    grad, total = np.zeros_like(z), 0.0
    for i in np.flatnonzero(use):
        p, n = int(own[i].argmax()), int(other[i].argmin())
        loss = d[i, p] - d[i, n] + margin * (1 + abs(risk[i] - risk[n]))
        if loss > 0:
            total += loss
            gp, gn = (z[i] - z[p]) / d[i, p], (z[i] - z[n]) / d[i, n]
            grad[i] += gp - gn
            grad[p] -= gp
            grad[n] += gn
    k = max(int(use.sum()), 1)
    return total / k, grad / k


def contrastive(z, y, risk, margin: float):
    """Own-class pairs pull by squared distance, others push within the risk-aware margin."""
    import numpy as np

    gap = z[:, None] - z[None]
    d = np.sqrt(np.maximum((gap**2).sum(2), 1e-12))
    same = y[:, None] == y[None]
    short = np.maximum(margin * (1 + np.abs(risk[:, None] - risk[None])) - d, 0)
    np.fill_diagonal(short, 0)
    value = np.where(same, d**2, short**2)
    slope = np.where(same, 2.0, -2 * short / d)
    np.fill_diagonal(slope, 0)
    k = max(len(z) * (len(z) - 1), 1)
    return float(value.sum() - np.trace(np.where(same, d**2, 0))) / k, 2 * (slope[:, :, None] * gap).sum(1) / k


def loss_and_gradient(w: dict, x, y, risk, metric=triplet, margin: float = 0.2, weights=(1.0, 0.5, 0.5)):
    import numpy as np

    z, (x0, h0, h1, norm, unit) = forward(w, x)
    logits = z @ w["Wc"] + w["bc"]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    n = len(x)
    ce = -np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean()
    gl = p.copy()
    gl[np.arange(n), y] -= 1
    gl *= weights[0] / n
    r = (z @ w["Wr"] + w["br"])[:, 0] - risk
    gr = (weights[1] * 2 / n * r)[:, None]
    m, gm = metric(z, y, risk, margin)
    gz = gl @ w["Wc"].T + gr @ w["Wr"].T + weights[2] * gm
    g = {"Wc": z.T @ gl, "bc": gl.sum(0), "Wr": z.T @ gr, "br": gr.sum(0)}
    raw = (gz - z * (gz * z).sum(1, keepdims=True)) / norm if unit else gz
    g["W2"], g["b2"] = h1.T @ raw, raw.sum(0)
    a = (raw @ w["W2"].T) * (h1 > 0)
    g["W1"], g["b1"] = h0.T @ a, a.sum(0)
    a = (a @ w["W1"].T) * (h0 > 0)
    g["W0"], g["b0"] = x0.T @ a, a.sum(0)
    return weights[0] * ce + weights[1] * (r**2).mean() + weights[2] * m, g


def _adamw(w: dict, m: dict, v: dict, g: dict, t: int, rate: float, decay: float) -> dict:
    """Weights after step t; the moments m and v are updated in place."""
    import numpy as np

    for k in w:
        m[k] = 0.9 * m[k] + 0.1 * g[k]
        v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
    return {k: w[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) for k in w}


def train(x, y, risk, x_val, y_val, risk_val, dim: int = 4, epochs: int = 12, batch: int = 64, rate: float = 1e-2, decay: float = 1e-4, patience: int = 4, seed: int = 7, metric=triplet):
    """AdamW without shuffling, early stop on validation loss, best state. Returns weights and history."""
    import numpy as np

    w = init(x.shape[1], dim, int(max(y.max(), y_val.max())) + 1, seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    best, best_loss, waited, t, history = w, np.inf, 0, 0, []
    for _ in range(epochs):
        for i in range(0, len(x), batch):
            t += 1
            _, g = loss_and_gradient(w, x[i : i + batch], y[i : i + batch], risk[i : i + batch], metric)
            w = _adamw(w, m, v, g, t, rate, decay)
        loss, _ = loss_and_gradient(w, x_val, y_val, risk_val, metric)
        history.append(float(loss))
        if loss < best_loss - 1e-9:
            best, best_loss, waited = w, loss, 0
        elif (waited := waited + 1) >= patience:
            break
    return best, history


def fit(df: DataFrame, vector: str, label: str, risk: str, is_train, limit: int = 5000, **settings) -> dict:
    """Train on a bounded sample of rows, the first `limit` of each side in the order of a digest of ids
    (sample_id); z-scores come from all training rows."""
    import numpy as np

    from tidemark.operators.metrics import zscore_stats

    rows = df.withColumn("__train", is_train)
    stats = zscore_stats(rows.filter("__train"), vector).orderBy("dim").collect()
    mean, std = np.array([r["mean"] for r in stats]), np.array([r["std"] for r in stats])

    def side(flag: bool):
        own = rows.filter(F.col("__train") == flag).orderBy(F.sha2(F.col("sample_id").cast("string"), 256), "sample_id").limit(limit)
        got = own.select(vector, label, risk).collect()
        return (np.array([r[0] for r in got]) - mean) / std, np.array([r[1] for r in got], int), np.array([r[2] for r in got], float)

    w, history = train(*side(True), *side(False), **settings)
    return {"version": VERSION, "mean": mean.tolist(), "std": std.tolist(), "weights": {k: a.tolist() for k, a in w.items()}, "history": history}


def _grouped(pdf, mean, std):
    """The rows of a group as one, in the order of their digests."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values(["d", "id"])
    x = (np.stack(pdf["x"].to_numpy()).astype(float) - mean) / std
    first = pdf.iloc[:1]
    return pd.DataFrame({"train": first["train"].to_numpy(), "batch": first["batch"].to_numpy(), "n": [len(pdf)], "x": [x.tobytes()], "y": [pdf["y"].tolist()], "risk": [pdf["risk"].tolist()]})


def _group_sums(batches: Iterator, w: dict, names: list[str], metric) -> Iterator:
    """Rows, loss and gradient of a task's groups, each group weighed by its rows; no gradient without names."""
    import numpy as np
    import pandas as pd

    total = np.zeros(2 + sum(w[k].size for k in names))
    for b in batches:
        for r in b.itertuples():
            x = np.frombuffer(r.x).reshape(r.n, -1)
            loss, g = loss_and_gradient(w, x, np.asarray(r.y, int), np.asarray(r.risk, float), metric)
            total += r.n * np.concatenate([[1.0, loss], *(g[k].ravel() for k in names)])
    yield pd.DataFrame({"sums": [total.tolist()]})


def _mean_of_groups(groups: DataFrame, w: dict, names: list[str], metric):
    """Mean loss over all rows of these groups, and its gradient by name."""
    import numpy as np

    parts = groups.mapInPandas(partial(_group_sums, w=w, names=names, metric=metric), "sums array<double>")
    rows = parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # a number for each weight
    s = np.array([r.s for r in rows])
    g, at = {}, 2
    for k in names:
        g[k] = s[at : at + w[k].size].reshape(w[k].shape) / s[0]
        at += w[k].size
    return float(s[1] / s[0]), g


def training_groups(df: DataFrame, vector: str, label: str, risk: str, is_train, steps: int, group: int) -> tuple[DataFrame, list, list, int]:
    """Both sides dealt into groups of about that many rows by a digest of sample_id, and groups into `steps` batches, as a
    table partitioned by side and batch; with mean and deviation of each dimension over training rows, and the classes."""
    from tidemark.operators.metrics import zscore_stats

    key = F.col("sample_id").cast("string")
    rows = df.select(key.alias("id"), F.sha2(key, 256).alias("d"), F.col(vector).alias("x"), F.col(label).cast("int").alias("y"), F.col(risk).cast("double").alias("risk"), is_train.alias("train"))
    unusable = F.greatest(*[F.col(c).isNull() for c in rows.columns])
    seen = {r["train"]: r for r in rows.groupBy("train").agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max(unusable).alias("bad")).collect()}
    if set(seen) != {True, False} or any(r["bad"] for r in seen.values()):
        raise ValueError("needs training and validation rows, and no nulls in them")
    stats = zscore_stats(rows.filter("train"), "x").orderBy("dim").collect()
    mean, std = [r["mean"] for r in stats], [r["std"] for r in stats]
    many = {side: -(-r["n"] // group) for side, r in seen.items()}
    dealt = rows.withColumn("group", F.conv(F.substring("d", 1, 15), 16, 10).cast("long") % F.when(F.col("train"), many[True]).otherwise(many[False]))
    if dealt.groupBy("train", "group").count().agg(F.max("count")).first()[0] > 8 * group + 64:
        raise ValueError("sample_id repeats too often to deal rows into groups")
    dealt = dealt.withColumn("batch", F.when(F.col("train"), F.col("group") % steps).otherwise(F.lit(0)).cast("int"))
    shape = "train boolean, batch int, n int, x binary, y array<int>, risk array<double>"
    packed = dealt.groupBy("train", "group").applyInPandas(lambda pdf: _grouped(pdf, mean, std), shape)
    path = scratch(df.sparkSession, "groups")
    packed.write.partitionBy("train", "batch").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(packed.schema).parquet(path), mean, std, max(r["y"] for r in seen.values()) + 1


def fit_all(df: DataFrame, vector: str, label: str, risk: str, is_train, dim: int = 4, epochs: int = 12, steps: int = 16, group: int = 64, rate: float = 1e-2, decay: float = 1e-4, patience: int = 4, seed: int = 7, metric=triplet) -> dict:
    """Train on all rows. A step is one pass over its batch, a `steps`-th of the training rows: tasks sum up the gradients of
    groups, within which the metric loss compares rows, and the driver holds weights and their moments alone. Stops early
    on the mean loss over all validation groups and keeps the best weights.

    With one step and one group it takes the same way as `train` with all rows in a batch. Nulls in any of the columns, a
    side without rows, and ids so often repeated that a group grows unbounded are errors."""
    import numpy as np

    groups, mean, std, classes = training_groups(df, vector, label, risk, is_train, steps, group)
    w = init(len(mean), dim, classes, seed)
    names = sorted(w)
    held = sorted(r["batch"] for r in groups.filter("train").select("batch").distinct().collect())  # `steps` at most
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    best, best_loss, waited, t, history = w, np.inf, 0, 0, []
    for _ in range(epochs):
        for batch in held:
            t += 1
            _, g = _mean_of_groups(groups.filter(F.col("train") & (F.col("batch") == batch)), w, names, metric)
            w = _adamw(w, m, v, g, t, rate, decay)
        loss, _ = _mean_of_groups(groups.filter(~F.col("train")), w, [], metric)
        history.append(loss)
        if loss < best_loss - 1e-9:
            best, best_loss, waited = w, loss, 0
        elif (waited := waited + 1) >= patience:
            break
    return {"version": VERSION, "mean": mean, "std": std, "weights": {k: a.tolist() for k, a in best.items()}, "history": history}


def apply(df: DataFrame, vector: str, state: dict, keep: list[str]) -> DataFrame:
    """z of every row by frozen weights."""
    import numpy as np

    if state.get("version") != VERSION:
        raise ValueError(f"unknown version {state.get('version')!r}")
    kinds = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep), "z array<double>"])
    w = {k: np.asarray(a) for k, a in state["weights"].items()}
    if not all(np.isfinite(a).all() for a in w.values()):
        raise ValueError("weights that are not finite")

    def rows(batches):
        for b in batches:
            if len(b):
                x = (np.stack(b[vector].to_numpy()).astype(float) - state["mean"]) / state["std"]
                yield b[keep].assign(z=forward(w, x)[0].tolist())

    return df.select(*dict.fromkeys([*keep, vector])).mapInPandas(rows, kinds)


def dump(state: dict) -> str:
    return json.dumps(state, sort_keys=True, separators=(",", ":"), allow_nan=False)
