"""Queries on fitted models, simulated spectra, transport and resampling. SQL can't say these; tests hold
them against brute force or invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import split_of
from tidemark.operators import cone, density, embed, events, folds, hmm, resample, spectra, tensor, transport, windows
from tidemark.operators.quantiles import quantile_values
from tidemark.plans import alarms
from tidemark.plans.registry import query, sql
from tidemark.sources import simulate
from tidemark.sources.frames import read_table


def _simulated(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """A simulated sequence for each user of `events`: spectra grow with the tables."""
    return simulate.simulate(spark, read_table(spark, sf_dir, "events").select("user_id").distinct().count(), **more)



def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime frames with the label as an index and a one-dimensional vector."""
    frames = alarms.regime_frames(spark, sf_dir)
    index = F.expr(" ".join(["CASE regime_label", *(f"WHEN '{s}' THEN {k}" for k, s in enumerate(hmm.STATES)), "END"]))
    return frames.select("sequence_id", "timestamp", "sample_id", "label", index.alias("obs"), F.array(F.col("risk_score")).alias("z"))


def _fitted(frames: DataFrame) -> tuple[dict, list[float]]:
    train = frames.filter(split_of(F.col("sequence_id")) == "train").drop("z")
    return hmm.fit(train)


@query()
def hmm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _observed(spark, sf_dir)
    model = hmm.load(hmm.dump(_fitted(frames)[0]))
    out = hmm.with_persistence(hmm.infer(frames.drop("z"), model), model, [0])
    return out.select("sequence_id", "sample_id", "state_mle", F.round("p_confirmable", 9).alias("p_confirmable"), F.round("persistence_seconds", 6).alias("persistence_seconds"), "stability_grade")


def _walks(model: dict, opening: list[str] | None = None) -> str:
    """SQL of the forward and backward passes of a chain over discrete observations, in scaled probabilities. opening:
    SQL of the initial probabilities, if they are not the model's."""
    n = len(model["initial"])
    a, e = model["transition"], model["emission"]
    first = opening or [repr(float(x)) for x in model["initial"]]
    seen = lambda k, o: "CASE " + o + " ".join(["", *(f"WHEN {j} THEN {float(e[k, j])!r}" for j in range(n))]) + " END"
    into = lambda k: "(" + " + ".join(f"w.f{i} * {float(max(a[i, k], 1e-12))!r}" for i in range(n)) + f") * {seen(k, 'x.obs')}"
    back = lambda k: " + ".join(f"{float(max(a[k, i], 1e-12))!r} * w.b{i} * {seen(i, 'w.obs')}" for i in range(n))
    scaled = lambda p, values: ", ".join(f"({v}) / ({' + '.join(f'({x})' for x in values)}) AS {p}{k}" for k, v in enumerate(values))
    logged = lambda values: f"ln({' + '.join(f'({x})' for x in values)}) AS l"
    start, step = [f"{first[k]} * {seen(k, 'obs')}" for k in range(n)], [into(k) for k in range(n)]
    return f"""numbered AS (SELECT sequence_id, sample_id, CASE regime_label WHEN 'trusted' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END AS obs,
      row_number() OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) AS n, count(*) OVER (PARTITION BY sequence_id) AS last FROM regimes),
    ahead AS (SELECT sequence_id, n, sample_id, {scaled("f", start)}, {logged(start)} FROM numbered WHERE n = 1
      UNION ALL SELECT x.sequence_id, x.n, x.sample_id, {scaled("f", step)}, {logged(step)} FROM ahead w JOIN numbered x ON x.sequence_id = w.sequence_id AND x.n = w.n + 1),
    behind AS (SELECT sequence_id, n, sample_id, obs, {", ".join(f"1.0::DOUBLE AS b{k}" for k in range(n))} FROM numbered WHERE n = last
      UNION ALL SELECT x.sequence_id, x.n, x.sample_id, x.obs, {scaled("b", [back(k) for k in range(n)])} FROM behind w JOIN numbered x ON x.sequence_id = w.sequence_id AND x.n = w.n - 1)"""


_CHAIN = sql("regimes", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _walks(hmm.start())


@query(_CHAIN + "SELECT sample_id, round(f0, 6) AS p0, round(f1, 6) AS p1, round(f2, 6) AS p2, round(f3, 6) AS p3 FROM ahead")
def hmm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered states of the model before any fit, dumped and loaded as a frozen one is."""
    out = hmm.infer(_observed(spark, sf_dir).drop("z"), hmm.load(hmm.dump(hmm.start())))
    return out.select("sample_id", *[F.round(F.col("p_state")[k], 6).alias(f"p{k}") for k in range(4)])


@query(_CHAIN + "SELECT sequence_id, round(sum(l), 6) AS log_likelihood FROM ahead GROUP BY 1")
def hmm_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.log_likelihoods(_observed(spark, sf_dir).drop("z"), hmm.start())
    return out.select("sequence_id", F.round("log_likelihood", 6).alias("log_likelihood"))


@query(_CHAIN + """SELECT sample_id, round(f0 * b0 / z, 6) AS p0, round(f1 * b1 / z, 6) AS p1, round(f2 * b2 / z, 6) AS p2, round(f3 * b3 / z, 6) AS p3
    FROM (SELECT a.*, b0, b1, b2, b3, f0 * b0 + f1 * b1 + f2 * b2 + f3 * b3 AS z FROM ahead a JOIN behind USING (sequence_id, n))""")
def hmm_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.infer(_observed(spark, sf_dir).drop("z"), hmm.start(), smoothing=True)
    return out.select("sample_id", *[F.round(F.col("p_state")[k], 6).alias(f"p{k}") for k in range(4)])


_STEPS = ", ".join(f"{float(x)!r}" for x in hmm.exit_steps(hmm.start(), [0]))


@query(_CHAIN + f"""SELECT sample_id, round(f0, 6) AS p_confirmable, CAST(list_position([f0, f1, f2, f3], greatest(f0, f1, f2, f3)) - 1 AS INTEGER) AS state_mle, round(f1 + 2 * f2 + 3 * f3, 6) AS state_expectation,
    round(CASE WHEN f0 <= 1e-12 THEN 0.0 ELSE list_dot_product([f0, f1, f2, f3], [{_STEPS}]) END, 6) AS persistence_seconds FROM ahead""")
def hmm_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most likely state, expectation and persistence by the expected exit time of the trusted state."""
    model = hmm.start()
    out = hmm.with_persistence(hmm.infer(_observed(spark, sf_dir).drop("z"), model), model, [0])
    return out.select("sample_id", F.round("p_confirmable", 6).alias("p_confirmable"), "state_mle", F.round("state_expectation", 6).alias("state_expectation"), F.round("persistence_seconds", 6).alias("persistence_seconds"))


_POLICY = f""", st AS (SELECT sequence_id, n, sample_id, f0 AS p, CASE WHEN f0 <= 1e-12 THEN 0.0 ELSE list_dot_product([f0, f1, f2, f3], [{_STEPS}]) END AS sec, f1 + 2 * f2 + 3 * f3 AS e,
      list_position([f0, f1, f2, f3], greatest(f0, f1, f2, f3)) AS m, -list_sum(list_transform([f0, f1, f2, f3], lambda x: least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0)))) AS h FROM ahead),
    al AS (SELECT *, coalesce(e - lag(e) OVER w > 0.75, false) OR coalesce(lag(m, 2) OVER w = m AND lag(m) OVER w <> m, false) AS alert FROM st WINDOW w AS (PARTITION BY sequence_id ORDER BY n)),
    pr AS (SELECT sequence_id, n, sample_id, sec < 0 OR h > 1.2 OR alert AS veto, p >= 0.85 AND sec >= 10 AS conf, p >= 0.6 AND sec >= 2 AS resc FROM al),
    walk AS (SELECT sequence_id, n, sample_id, CASE WHEN NOT veto AND conf THEN 1 ELSE 0 END AS c, CASE WHEN NOT veto AND resc THEN 1 ELSE 0 END AS r, 0 AS cool, CASE WHEN veto THEN 'HOLD' WHEN resc THEN 'RESCAN' ELSE 'HOLD' END AS action, CASE WHEN veto THEN 'VETO' WHEN resc THEN 'RESCAN' ELSE 'HOLD' END AS why FROM pr WHERE n = 1
      UNION ALL SELECT sequence_id, n, sample_id, c, CASE WHEN NOT veto AND c < 3 AND resc THEN r + 1 ELSE 0 END, CASE WHEN NOT veto AND c >= 3 THEN 5 ELSE greatest(cool - 1, 0) END,
        CASE WHEN veto THEN 'HOLD' WHEN c >= 3 OR cool > 0 THEN 'CONFIRM' WHEN resc THEN 'RESCAN' ELSE 'HOLD' END, CASE WHEN veto THEN 'VETO' WHEN c >= 3 THEN 'CONFIRM' WHEN cool > 0 THEN 'COOLDOWN_ACTIVE' WHEN resc THEN 'RESCAN' ELSE 'HOLD' END
        FROM (SELECT x.sequence_id, x.n, x.sample_id, x.veto, x.resc, w.r, w.cool, CASE WHEN NOT x.veto AND x.conf THEN w.c + 1 ELSE 0 END AS c FROM walk w JOIN pr x ON x.sequence_id = w.sequence_id AND x.n = w.n + 1))"""


@query(_CHAIN + _POLICY + " SELECT sequence_id, sample_id, action, why FROM walk")
def stability_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: regimes, filter, alerts, policy."""
    frames = _observed(spark, sf_dir).drop("z")
    model = hmm.start()
    state = hmm.with_persistence(hmm.infer(frames, model), model, [0])
    alerted = windows.expectation_alerts(state, F.col("state_expectation"), F.col("state_mle"))
    return folds.policy(hmm.policy_predicates(alerted)).select("sequence_id", "sample_id", "action", "why")


def _em_step(model: dict) -> str:
    """SQL of one step of EM from the model, its initial distribution being that of the first observations."""
    n = range(len(model["initial"]))
    a, e = np.clip(model["transition"], 1e-12, None), model["emission"]
    emit = lambda k: "CASE y.obs " + " ".join(f"WHEN {j} THEN {float(e[k, j])!r}" for j in n) + " END"
    cells = [(i, j) for i in n for j in n]
    xi = ", ".join(f"x.f{i} * {float(a[i, j])!r} * {emit(j)} * y.b{j} AS m{i}{j}" for i, j in cells)
    total = " + ".join(f"m{i}{j}" for i, j in cells)
    norm = "(" + " + ".join(f"f{k} * b{k}" for k in n) + ")"
    prior, near = hmm.dirichlet(len(n)), len(n) if model["band"] is None else model["band"]
    kept = [(i, j) for i, j in cells if abs(i - j) <= near]
    return f""", xi AS (SELECT {xi} FROM ahead x JOIN behind y ON y.sequence_id = x.sequence_id AND y.n = x.n + 1), moved AS (SELECT {", ".join(f"sum(m{i}{j} / ({total})) AS m{i}{j}" for i, j in cells)} FROM xi),
    g AS (SELECT a.n, obs, {", ".join(f"f{k} * b{k} / {norm} AS g{k}" for k in n)} FROM ahead a JOIN behind USING (sequence_id, n)),
    opened AS (SELECT {", ".join(f"avg(g{k}) AS g{k}" for k in n)} FROM g WHERE n = 1), met AS (SELECT {", ".join(f"coalesce(sum(g{i}) FILTER (obs = {j}), 0) AS s{i}{j}" for i, j in cells)} FROM g),
    told AS ({" UNION ALL ".join(f"SELECT 'initial' AS part, 0 AS i, {k} AS j, g{k} AS v FROM opened" for k in n)}
      UNION ALL {" UNION ALL ".join(f"SELECT 'transition', {i}, {j}, m{i}{j} + {float(prior[i, j])!r} FROM moved" for i, j in kept)} UNION ALL {" UNION ALL ".join(f"SELECT 'emission', {i}, {j}, s{i}{j} + {float(e[i, j])!r} FROM met" for i, j in cells)})
    SELECT part, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v / sum(v) OVER (PARTITION BY part, i), 6) AS p FROM told"""


_OPENING = [f"(SELECT greatest(count(*) FILTER (obs = {k}) / count(*), 1e-12) FROM numbered WHERE n = 1)" for k in range(4)]


@query(sql("regimes", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _walks(hmm.start(), _OPENING) + _em_step(hmm.start()))
def hmm_em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of EM over all sequences: where they start, expected transitions under the band and the prior, emissions."""
    return _step_rows(spark, sf_dir, hmm.start())


def _step_rows(spark: SparkSession, sf_dir: str, start: dict) -> DataFrame:
    model, _ = hmm.fit(_observed(spark, sf_dir).drop("z"), iterations=1, model=start)
    rows = [("initial", 0, k, float(p)) for k, p in enumerate(model["initial"])]
    near = 4 if model["band"] is None else model["band"]
    for part in ("transition", "emission"):
        rows += [(part, i, j, float(model[part][i, j])) for i in range(4) for j in range(4) if part == "emission" or abs(i - j) <= near]
    return spark.createDataFrame(rows, "part string, i int, j int, p double").withColumn("p", F.round("p", 6))


@query(sql("regimes", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _walks(hmm.start(band=None), _OPENING) + _em_step(hmm.start(band=None)))
def hmm_unbanded_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same step of the unstructured chain: any state may follow any other."""
    return _step_rows(spark, sf_dir, hmm.start(band=None))


@query()
def hmm_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, history = _fitted(_observed(spark, sf_dir))
    rows = [(i, j, float(model["transition"][i, j])) for i in range(4) for j in range(4)]
    return spark.createDataFrame([(*r, len(history), history[-1]) for r in rows], "from_state int, to_state int, p double, iterations int, log_likelihood double")


@query()
def simulated_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _simulated(spark, sf_dir)
    return rows.select("sample_id", "sequence_id", "timestamp", "label", "agent_id", "clipping_fraction", F.size("spectrum").alias("channels"))


@query()
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.indicators(_simulated(spark, sf_dir))


@query()
def matched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened matched filter fitted to benign spectra, applied to all."""
    rows = _simulated(spark, sf_dir)
    grid = simulate.grid()
    template = -simulate.library(grid)[:2].sum(0)
    state = spectra.whitened_filter(rows.filter("label = 'benign'"), template)
    return spectra.apply_filter(rows, state).select("sample_id", "label", "filter_score")


@query()
def cone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cone detector by two-fold cross-fitting over sequences."""
    return cone.cross_fit(_simulated(spark, sf_dir))


@query()
def embeddings_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").alias("x"), (F.col("label") % 4).cast("int").alias("y"), (F.col("label") / 10).alias("risk")
    )
    state = embed.fit(rows, "x", "y", "risk", split_of(F.col("sample_id")) == "train")
    return embed.apply(rows, "x", state, ["sample_id"])


@query()
def embedding_of_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by weights that were trained on all training rows, in passes over batches dealt by digests."""
    rows = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").alias("x"), (F.col("label") % 4).cast("int").alias("y"), (F.col("label") / 10).alias("risk")
    )
    state = embed.fit_all(rows, "x", "y", "risk", split_of(F.col("sample_id")) == "train", epochs=6, steps=4)
    return embed.apply(rows, "x", state, ["sample_id"])


#: References of each class that a cloud has at most: the bound of what transport holds on the driver.
REFERENCES = 2000


def _clouds(spark: SparkSession, sf_dir: str, n: int = REFERENCES):
    rows = read_table(spark, sf_dir, "embeddings")
    return rows, transport.references(rows, "vec_id", "embedding", F.col("label") < 3, n)


@query()
def ot_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, (h, b) = _clouds(spark, sf_dir)
    state = transport.fit_coordinate(h, b, 0.5)
    return transport.coordinate(rows, "embedding", state, ["vec_id", "label"])


@query()
def sinkhorn_w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (h, b) = _clouds(spark, sf_dir)
    cost = transport.squared_cost(h, b)
    gaussian = transport.gaussian_w2(h.mean(0), np.cov(h.T), b.mean(0), np.cov(b.T))
    return spark.createDataFrame([(transport.sinkhorn_w2(cost, 0.1 * float(np.median(cost))), gaussian, len(h), len(b))], "sinkhorn double, gaussian double, n_hazard int, n_benign int")


@query()
def discriminant_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (h, b) = _clouds(spark, sf_dir)
    fit = transport.fit_discriminant(h, b, 2)
    return spark.createDataFrame([(i, float(r[0]), float(r[1])) for i, r in enumerate(fit["projection"])], "dim int, axis_1 double, axis_2 double")


def _draws(replicates: int, seed: int) -> str:
    """SQL of the draws of `resample.multiplicities` among the rows of a table `units` (id)."""
    return f"""placed AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM units), size AS (SELECT count(*) AS n FROM units),
    each AS (SELECT replicate, n, unnest(range(n)) AS j FROM size, range({replicates}) t(replicate)),
    drawn AS (SELECT replicate, id, count(*) AS k FROM (SELECT replicate, ('0x' || substr(md5('{seed}:' || replicate || ':' || j), 1, 15))::BIGINT % n AS position FROM each) JOIN placed USING (position) GROUP BY ALL)"""


DRAWS = 1000


@query(sql("alarms", "").rstrip() + f""", units AS (SELECT sequence_id || '/' || island AS id, CASE WHEN confirm_timestamp IS NOT NULL THEN 1.0 ELSE 0.0 END AS v FROM alarms WHERE NOT is_hazard),
    {_draws(DRAWS, 11)}, means AS (SELECT replicate, sum(k * v) / sum(k) AS m FROM drawn JOIN units USING (id) GROUP BY replicate)
    SELECT round((SELECT avg(v) FROM units), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, count(*) AS replicates FROM means""")
def bootstrap_fcr_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.alarm_events(alarms.action_frames(spark, sf_dir)).filter(~F.col("is_hazard"))
    rows = found.select(F.concat_ws("/", "sequence_id", "island").alias("id"), F.col("pred_confirmed").cast("double").alias("v"))
    out = resample.bootstrap_mean(rows, "id", "v", DRAWS, 11)
    return out.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")], "replicates")


def _arm_sql(n: int) -> str:
    """SQL of what resampling needs of an arm of n of 5."""
    w = "(PARTITION BY sequence_id ORDER BY timestamp, sample_id"
    return f"""act{n} AS (SELECT *, CASE WHEN sum(CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END) OVER {w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= {n} THEN 'CONFIRM' WHEN risk_score >= 0.5 THEN 'RESCAN' ELSE 'HOLD' END AS action FROM regimes),
    steps{n} AS (SELECT *, CASE WHEN action <> lag(action) OVER {w}) THEN 1 ELSE 0 END AS changed, CASE WHEN action <> 'HOLD' AND coalesce(lag(action) OVER {w}), 'HOLD') = 'HOLD' THEN 1 ELSE 0 END AS opens FROM act{n}),
    runs{n} AS (SELECT *, sum(opens) OVER {w}) AS island FROM steps{n}),
    found{n} AS (SELECT sequence_id, island, bool_or(action = 'CONFIRM') AS c, bool_or(label = 'hazard') AS h FROM runs{n} WHERE action <> 'HOLD' GROUP BY ALL),
    arm{n} AS (SELECT sequence_id AS id, t.toggle_rate, coalesce(e.be, 0) AS be, coalesce(e.bc, 0) AS bc, coalesce(e.he, 0) AS he, coalesce(e.hc, 0) AS hc
      FROM (SELECT sequence_id, sum(changed) / greatest(max(timestamp) - min(timestamp), 1.0) AS toggle_rate FROM steps{n} GROUP BY 1) t
      LEFT JOIN (SELECT sequence_id, count(*) FILTER (NOT h) AS be, count(*) FILTER (NOT h AND c) AS bc, count(*) FILTER (h) AS he, count(*) FILTER (h AND c) AS hc FROM found{n} GROUP BY 1) e USING (sequence_id))"""


_RATES = "CASE WHEN sum(k * be) > 0 THEN sum(k * bc) / sum(k * be) END AS fcr, CASE WHEN sum(k * he) > 0 THEN 1 - sum(k * hc) / sum(k * he) END AS mcr, sum(k * toggle_rate) / sum(k) AS toggle_rate"


@query(sql("regimes", "").rstrip() + f""", {_arm_sql(3)}, {_arm_sql(2)}, units AS (SELECT id FROM arm3), {_draws(DRAWS, 5)},
    weighed AS (SELECT replicate, id, k FROM drawn UNION ALL SELECT -1, id, 1 FROM units),
    a AS (SELECT replicate, {_RATES} FROM weighed JOIN arm3 USING (id) GROUP BY replicate), b AS (SELECT replicate, {_RATES} FROM weighed JOIN arm2 USING (id) GROUP BY replicate),
    d AS (SELECT replicate, unnest(['fcr', 'mcr', 'toggle_rate']) AS metric, unnest([a.fcr - b.fcr, a.mcr - b.mcr, a.toggle_rate - b.toggle_rate]) AS d FROM a JOIN b USING (replicate))
    SELECT metric, round(max(d) FILTER (replicate < 0), 9) AS point, round(CASE WHEN count(d) FILTER (replicate >= 0) >= 950 THEN quantile_cont(d, 0.025) FILTER (replicate >= 0) END, 9) AS low,
    round(CASE WHEN count(d) FILTER (replicate >= 0) >= 950 THEN quantile_cont(d, 0.975) FILTER (replicate >= 0) END, 9) AS high, count(d) FILTER (replicate >= 0) AS n_finite FROM d GROUP BY metric""")
def paired_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = alarms.regime_frames(spark, sf_dir).withColumn("score", F.col("risk_score"))
    arms = []
    for n, m in ((3, 5), (2, 5)):
        actions = windows.n_of_m(frames, n, m, 0.5)
        arms.append(events.per_sequence(actions, events.alarm_events(actions)).drop("toggles"))
    out = resample.paired_cluster_bootstrap(*arms, replicates=DRAWS, seed=5, least=950)
    return out.select("metric", *[F.round(c, 9).alias(c) for c in ("point", "low", "high")], "n_finite")


@query(sql("regimes", "").rstrip() + f""", units AS (SELECT DISTINCT sequence_id AS id FROM regimes), {_draws(DRAWS, 3)},
    steps AS (SELECT replicate, risk_score AS s, sum(CASE WHEN label = 'hazard' THEN k ELSE 0 END) AS pos, sum(CASE WHEN label = 'hazard' THEN 0 ELSE k END) AS neg FROM drawn JOIN regimes ON id = sequence_id GROUP BY ALL),
    run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps),
    areas AS (SELECT replicate, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM run GROUP BY replicate)
    SELECT round(avg(auc), 9) AS mean, round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.975), 9) AS high, count(auc) AS n_finite FROM areas""")
def cluster_auc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.cluster_auc(alarms.regime_frames(spark, sf_dir), "risk_score", F.col("label") == "hazard", DRAWS, 3)
    return out.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")], "n_finite")


def _drawn(name: str, replicates: int, seed: int) -> str:
    """The draws among the rows of a table units_<name>, as drawn_<name>."""
    return _draws(replicates, seed).replace("units", f"units_{name}").replace("placed", f"placed_{name}").replace("size AS", f"size_{name} AS").replace("FROM size,", f"FROM size_{name},").replace("each", f"each_{name}").replace("drawn AS", f"drawn_{name} AS")


@query(f"""WITH rows_ AS (SELECT CAST(doc_id AS VARCHAR) AS id, toxic = 1 AS y, n_chars::DOUBLE AS a, (doc_id * 7919 % 1000)::DOUBLE AS b FROM documents JOIN labels USING (doc_id)),
    units_p AS (SELECT id FROM rows_ WHERE y), units_n AS (SELECT id FROM rows_ WHERE NOT y), {_drawn("p", DRAWS, 21)}, {_drawn("n", DRAWS, 22)}, drawn AS (SELECT * FROM drawn_p UNION ALL SELECT * FROM drawn_n),
    long AS (SELECT replicate, k, y, 'a' AS arm, a AS s FROM drawn JOIN rows_ USING (id) UNION ALL SELECT replicate, k, y, 'b', b FROM drawn JOIN rows_ USING (id)),
    steps AS (SELECT replicate, arm, s, sum(CASE WHEN y THEN k ELSE 0 END) AS pos, sum(CASE WHEN y THEN 0 ELSE k END) AS neg FROM long GROUP BY ALL),
    run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate, arm ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps),
    areas AS (SELECT replicate, arm, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM run GROUP BY ALL),
    told AS (SELECT arm, auc FROM areas UNION ALL SELECT 'b-a', x.auc - z.auc FROM areas x JOIN areas z USING (replicate) WHERE x.arm = 'b' AND z.arm = 'a')
    SELECT arm, round(avg(auc), 9) AS mean, round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.975), 9) AS high, count(auc) AS n_finite FROM told GROUP BY arm""")
def stratified_auc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of two scores over the same class-stratified draws, and their contrast."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), (F.col("toxic") == 1).alias("y"), F.col("n_chars").cast("double").alias("a"), (F.col("doc_id") * 7919 % 1000).cast("double").alias("b"))
    out = resample.stratified_auc(rows, "id", F.col("y"), ["a", "b"], DRAWS, (21, 22))
    return out.select("arm", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")], "n_finite")


@query()
def logistic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 3).cast("double"))
    model = density.logistic(rows.filter(split_of(F.col("vec_id")) == "train"), "embedding", "y")
    return density.logistic_scores(rows, "embedding", model, ["vec_id"])


@query()
def chain_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture and chain densities of hazard-rich and other sequences, fitted to all training sequences, scored on all."""
    frames = _observed(spark, sf_dir).drop("obs")
    share = frames.groupBy("sequence_id").agg(F.avg((F.col("label") == "hazard").cast("double")).alias("share")).filter(split_of(F.col("sequence_id")) == "train")
    cut = quantile_values(share, "share", [0.5])[0]
    train = frames.join(share, "sequence_id").withColumn("side", (F.col("share") <= cut).cast("int"))
    fits = density.fit_sides(train, 1, {"mixture": False, "chain": True})
    models = {arm: (fits[arm, 0], fits[arm, 1]) for arm in ("mixture", "chain")}
    return density.chain_likelihood(frames, models)


@query()
def cp_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-2 decomposition of all vectors of each label, as vectors by eight blocks by eight channels, with the mean
    weights of its vectors."""
    x = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), x.alias("x"))
    model = tensor.cp_fit(rows, 8, 8, 2, restarts=2, steps=40, tolerance=1e-6)
    errors = spark.createDataFrame([(label, error) for label, (_, _, error) in model.items()], "label string, error double")
    means = tensor.cp_weights(rows, model).groupBy("label").agg(F.count("*").alias("n"), *[F.avg(F.col("weights")[k]).alias(f"weight{k}") for k in range(2)])
    return means.join(errors, "label").withColumnRenamed("label", "family")


@query("""WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS raw, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), x AS (SELECT vec_id, i, abs(raw) + 0.01 AS x, -1 + 2 * i / 63.0 AS spot FROM parts),
    y AS (SELECT i, spot, avg(ln(greatest(x, 1e-12))) AS y FROM x GROUP BY i, spot), fit AS (SELECT regr_slope(y, spot) AS b, regr_intercept(y, spot) AS a FROM y)
    SELECT vec_id, round(sum(x / exp(a + b * spot)), 6) AS total, round(max(x / exp(a + b * spot)), 6) AS highest FROM x, fit GROUP BY vec_id""")
def self_calibrated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, divided by the gain that their mean logarithms show."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.01).alias("x"))
    out = tensor.self_calibrated(rows, "x", 64, 1)
    return out.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("x"), 6).alias("highest"))


@query()
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event metrics of four baselines on the same regime frames, by split."""
    from tidemark.plans import experiment
    from tidemark.sources.frames import event_frames

    rows = experiment.run_arms(experiment.with_regimes(event_frames(spark, sf_dir).drop("props")), experiment.baselines())
    return rows.select("method", "split", "n_events", "fcr", "mcr", "toggle_rate", "suppression_efficiency")


@query()
def ratio_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans import probes

    return probes.recovery(spark, [0.02, 0.1], [0.0, 0.05, 0.2])


@query()
def detection_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans import probes

    return probes.detection_power(spark, [0.05, 0.1, 0.2, 0.4])
