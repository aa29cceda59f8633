"""Queries on experiments, audits, selection, detectors and reports, each with its SQL twin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clouds, cone, density, events, metrics, regimes, resample, transport, windows
from tidemark.operators.quantiles import attach, quantiles
from tidemark.plans import alarms, audit, experiment, probes, report
from tidemark.plans.registry import query, sql
from tidemark.plans.spectral_queries import CHANNELS, GRID, _matrix, _table
from tidemark.sources import sinks
from tidemark.sources.frames import event_frames, read_table

_W = "(PARTITION BY sequence_id ORDER BY timestamp, sample_id"


def _arm(name: str, action: str) -> str:
    """SQL of an arm's metrics by split, met_<name>, from its action on regime frames."""
    return f"""act_{name} AS (SELECT *, {action} AS action FROM regimes),
    steps_{name} AS (SELECT *, CASE WHEN action <> lag(action) OVER {_W}) THEN 1 ELSE 0 END AS changed, CASE WHEN action <> 'HOLD' AND coalesce(lag(action) OVER {_W}), 'HOLD') = 'HOLD' THEN 1 ELSE 0 END AS opens FROM act_{name}),
    runs_{name} AS (SELECT *, sum(opens) OVER {_W}) AS island FROM steps_{name}),
    found_{name} AS (SELECT sequence_id, split, island, bool_or(action = 'CONFIRM') AS c, bool_or(label = 'hazard') AS h FROM runs_{name} WHERE action <> 'HOLD' GROUP BY ALL),
    rate_{name} AS (SELECT split, avg(r) AS toggle_rate FROM (SELECT sequence_id, split, sum(changed) / greatest(max(timestamp) - min(timestamp), 1.0) AS r FROM steps_{name} GROUP BY ALL) GROUP BY 1),
    met_{name} AS (SELECT '{name}' AS method, split, coalesce(n_events, 0) AS n_events, coalesce(fcr, 0.0) AS fcr, coalesce(mcr, 1.0) AS mcr, toggle_rate, s AS suppression_efficiency FROM rate_{name}
      LEFT JOIN (SELECT split, count(*) AS n_events, CASE WHEN count(*) FILTER (NOT h) > 0 THEN count(*) FILTER (NOT h AND c) / count(*) FILTER (NOT h) ELSE 0.0 END AS fcr,
        1 - CASE WHEN count(*) FILTER (h) > 0 THEN count(*) FILTER (h AND c) / count(*) FILTER (h) ELSE 0.0 END AS mcr FROM found_{name} GROUP BY 1) USING (split)
      JOIN (SELECT split, 1 - avg(CASE WHEN action <> 'HOLD' THEN 1.0 ELSE 0.0 END) AS s FROM act_{name} GROUP BY 1) USING (split))"""


def _n_of_5(n: int) -> str:
    return f"CASE WHEN sum(CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END) OVER {_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= {n} THEN 'CONFIRM' WHEN risk_score >= 0.5 THEN 'RESCAN' ELSE 'HOLD' END"


_ARMS = sql("regimes", "").rstrip() + f""", {_arm("B0", "CASE WHEN risk_score >= 0.5 THEN 'CONFIRM' ELSE 'HOLD' END")}, {_arm("B1", _n_of_5(3))}, {_arm("N2", _n_of_5(2))},
    met AS (SELECT * FROM met_B0 UNION ALL SELECT * FROM met_B1 UNION ALL SELECT * FROM met_N2)"""


def arm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three arms on the same regime frames: the score's own threshold, three of five, two of five."""
    frames = alarms.regime_frames(spark, sf_dir).withColumn("score", F.col("risk_score")).drop("props")
    arms = {"B0": experiment.baselines()["B0"], "B1": lambda f: windows.n_of_m(f, 3, 5, 0.5), "N2": lambda f: windows.n_of_m(f, 2, 5, 0.5)}
    return experiment.run_arms(frames, arms)


_METRICS = ("fcr", "mcr", "toggle_rate", "suppression_efficiency")


@query(_ARMS + "SELECT method, split, n_events, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM met")
def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_rows(spark, sf_dir).select("method", "split", "n_events", *[F.round(c, 6).alias(c) for c in _METRICS])


@query(_ARMS + "SELECT m.method, split, " + ", ".join(f"round(m.{c} - b.{c}, 6) AS delta_{c}" for c in _METRICS[:3]) + " FROM met m JOIN met_B0 b USING (split) WHERE m.method <> 'B0'")
def arm_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablated arms against the reference of the same split."""
    out = experiment.deltas(arm_rows(spark, sf_dir), "B0")
    return out.select("method", "split", *[F.round(f"delta_{c}", 6).alias(f"delta_{c}") for c in _METRICS[:3]])


_CRITERIA = _ARMS + """, own AS (SELECT * FROM met_N2 WHERE split = 'test'), b0 AS (SELECT * FROM met_B0 WHERE split = 'test'), b1 AS (SELECT * FROM met_B1 WHERE split = 'test'),
    x AS (SELECT (SELECT toggle_rate FROM own) AS t, (SELECT toggle_rate FROM b0) AS t0, (SELECT toggle_rate FROM b1) AS t1, (SELECT fcr FROM own) AS fcr, (SELECT mcr FROM own) AS mcr, (SELECT mcr FROM b0) AS m0),
    c AS (SELECT 'toggle_reduction_vs_b0' AS criterion, CASE WHEN t0 > 0 THEN (t0 - t) / t0 WHEN t0 IS NULL THEN NULL WHEN t <= 0 THEN 0.0 ELSE -1.0 END AS value, 0.5 AS threshold, false AS most FROM x
      UNION ALL SELECT 'toggle_reduction_vs_b1', CASE WHEN t1 > 0 THEN (t1 - t) / t1 WHEN t1 IS NULL THEN NULL WHEN t <= 0 THEN 0.0 ELSE -1.0 END, 0.3, false FROM x
      UNION ALL SELECT 'mcr_delta_bound', mcr - m0, 0.05, true FROM x UNION ALL SELECT 'nominal_benign_fcr_threshold', fcr, 0.01, true FROM x UNION ALL SELECT 'robustness_catastrophic_failure', fcr, 0.1, true FROM x),
    judged AS (SELECT criterion, value, threshold, CASE WHEN value IS NULL THEN 'unevaluable' WHEN (most AND value <= threshold) OR (NOT most AND value >= threshold) THEN 'pass' ELSE 'fail' END AS status FROM c)"""


@query(_CRITERIA + "SELECT criterion, round(value, 6) AS value, threshold::DOUBLE AS threshold, status FROM judged")
def arm_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiment.acceptance(arm_rows(spark, sf_dir), "N2")
    return out.select("criterion", F.round("value", 6).alias("value"), "threshold", "status")


@query(_CRITERIA + """SELECT count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'unevaluable') AS n_unevaluable,
    CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'unevaluable') > 0 THEN 'partial' ELSE 'pass' END AS overall_status FROM judged""")
def overall_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overall(experiment.acceptance(arm_rows(spark, sf_dir), "N2"))


@query(_CRITERIA + """SELECT criterion, status, CASE WHEN contains(criterion, 'toggle') THEN 'stability' WHEN contains(criterion, 'mcr') THEN 'misses' WHEN contains(criterion, 'fcr') OR contains(criterion, 'catastrophic') THEN 'false_alarms' ELSE 'other' END AS family FROM judged WHERE status <> 'pass'""")
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.attribution(experiment.acceptance(arm_rows(spark, sf_dir), "N2")).select("criterion", "status", "family")


@query(_ARMS + """SELECT sequence_id, count(*) AS events, count(*) FILTER (NOT h) AS benign_events, count(*) FILTER (NOT h AND c) AS benign_confirmed, count(*) FILTER (h) AS hazard_events, count(*) FILTER (h AND c) AS hazard_confirmed FROM found_B1 GROUP BY 1""")
def sequence_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts of each sequence that has one, as resampling takes them."""
    actions = alarms.action_frames(spark, sf_dir)
    out = events.per_sequence(actions, events.alarm_events(actions)).withColumn("events", F.col("benign_events") + F.col("hazard_events"))
    return out.filter("events > 0").select("sequence_id", "events", "benign_events", "benign_confirmed", "hazard_events", "hazard_confirmed")


@query("""SELECT s_name AS name, row_number() OVER (ORDER BY s_nationkey = 3, s_acctbal <= 0, (s_suppkey % 7) / 100, (s_suppkey % 5) / 50, s_nationkey, s_suppkey) AS place,
    row_number() OVER (ORDER BY s_nationkey = 3, s_acctbal <= 0, (s_suppkey % 7) / 100, (s_suppkey % 5) / 50, s_nationkey, s_suppkey) = 1 AND s_acctbal > 0 AND s_nationkey <> 3 AS selected FROM supplier""")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by acceptability, rates and simplicity; those that failed are ranked last."""
    k = F.col("s_suppkey")
    rows = read_table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("acceptable"), (F.col("s_nationkey") == 3).alias("failed"), (k % 7 / 100).alias("fcr"), (k % 5 / 50).alias("mcr"),
        F.lit(0.0).alias("toggle_rate"), F.col("s_nationkey").alias("simplicity"), k.alias("position"),
    )
    return experiment.select_candidate(rows).select("name", F.col("place").cast("long").alias("place"), "selected")


_CONTRASTS = """x AS (SELECT l_returnflag AS arm, l_linestatus AS reference, l_linenumber AS seed, avg(l_discount) - 0.0501 AS fcr, avg(l_discount) - 0.0499 AS fcr_high, avg(l_tax) - 0.0405 AS mcr_low FROM lineitem GROUP BY ALL),
    r AS (SELECT arm, reference, count(*) = 7 AND count(*) FILTER (fcr_high < 0) >= 2 AND count(*) FILTER (fcr < 0) = 7 AS fcr_rule_met, count(*) = 7 AND count(*) FILTER (mcr_low > 0) = 0 AS mcr_safety_met FROM x GROUP BY ALL)"""


def _contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = F.avg("l_discount"), F.avg("l_tax")
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("reference"), F.col("l_linenumber").alias("seed")).agg(
        (a - 0.0501).alias("fcr"), (a - 0.0503).alias("fcr_low"), (a - 0.0499).alias("fcr_high"), (t - 0.0405).alias("mcr_low")
    )


@query(f"WITH {_CONTRASTS} SELECT * FROM r")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over seeds: improved in some, no worse in any, in one direction in all."""
    return experiment.decision_rule(_contrasts(spark, sf_dir), list(range(1, 8)))


@query(f"WITH {_CONTRASTS} SELECT arm, bool_and(fcr_rule_met AND mcr_safety_met) AS useful FROM r GROUP BY 1")
def useful_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.useful_arms(experiment.decision_rule(_contrasts(spark, sf_dir), list(range(1, 8))))


@query("""WITH s AS (SELECT l_linenumber AS severity, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1), d AS (SELECT a - lag(a) OVER (ORDER BY severity) AS a, b - lag(b) OVER (ORDER BY severity) AS b FROM s)
    SELECT 'delta_fcr' AS metric, round(greatest(max(a), 0.0), 9) AS value, 0.0001::DOUBLE AS threshold, CASE WHEN greatest(max(a), 0.0) <= 0.0001 THEN 'pass' ELSE 'fail' END AS status FROM d
    UNION ALL SELECT 'delta_mcr', round(greatest(max(b), 0.0), 9), 0.01::DOUBLE, CASE WHEN greatest(max(b), 0.0) <= 0.01 THEN 'pass' ELSE 'fail' END FROM d""")
def graceful_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest rise of a metric from one severity to the next, against its limit."""
    stress = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("severity")).agg(F.avg("l_discount").alias("delta_fcr"), F.avg("l_tax").alias("delta_mcr")).withColumn("name", F.col("severity").cast("string"))
    out = experiment.graceful(stress, {"delta_fcr": 0.0001, "delta_mcr": 0.01})
    return out.select("metric", F.round("value", 9).alias("value"), "threshold", "status")


@query("""WITH b AS (SELECT s_nationkey, avg(s_acctbal) AS t FROM supplier GROUP BY 1) SELECT count(*) FILTER (fall) AS violations, CASE WHEN count(*) < 2 THEN 'unevaluable' WHEN count(*) FILTER (fall) = 0 THEN 'pass' ELSE 'fail' END AS status
    FROM (SELECT t + 1e-12 < lag(t) OVER (ORDER BY s_nationkey) AS fall FROM b)""")
def bin_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = read_table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("double").alias("pred_mean")).agg(F.avg("s_acctbal").alias("target_mean"))
    return experiment.monotonicity(bins)


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), d AS (SELECT *, v - lag(v) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) AS step FROM s)
    SELECT l_returnflag, round(max(step), 6) AS largest_step, count(*) FILTER (-step > 100) AS n_breaks FROM d GROUP BY 1""")
def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along the ordered bins of each group: the largest rise, and falls beyond a tolerance."""
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("v"))
    breaks = metrics.monotone_breaks(rows, "l_linenumber", "v", 100.0, ["l_returnflag"]).groupBy("l_returnflag").agg(F.count("*").alias("n_breaks"))
    out = metrics.largest_step(rows, "l_linenumber", "v", ["l_returnflag"]).join(breaks, "l_returnflag", "left").fillna(0, ["n_breaks"])
    return out.select("l_returnflag", F.round("largest_step", 6).alias("largest_step"), "n_breaks")


@query("""SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.025) FILTER (c_acctbal >= 0), 6) AS low, round(quantile_cont(c_acctbal, 0.975) FILTER (c_acctbal >= 0), 6) AS high, count(*) FILTER (c_acctbal >= 0) AS n_finite FROM customer GROUP BY 1""")
def finite_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals over the draws that are finite."""
    rows = read_table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))))
    out = experiment.finite_interval(rows, "v", ["c_nationkey"])
    return out.select("c_nationkey", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_finite")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'UNEVALUABLE' WHEN c_acctbal > 8000 THEN 'CONFIRM' WHEN c_acctbal > 4000 THEN 'RESCAN' ELSE 'HOLD' END AS action, 'UNEVALUABLE' AS uncalibrated FROM customer""")
def displayed_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated policy on scores, some of which are missing; without thresholds nothing can be told."""
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("score"))
    out = experiment.display_policy(rows, F.lit(8000.0), F.lit(4000.0))
    none = experiment.display_policy(rows, None, None).select("c_custkey", F.col("action").alias("uncalibrated"))
    return out.select("c_custkey", "action").join(none, "c_custkey")


@query("SELECT o_orderkey, o_orderstatus AS config_hash FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def other_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side inputs whose configuration hash is another than the run's."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("config_hash"))
    return experiment.corresponds(rows, "F")


@query("""SELECT 'customers' AS gate, CASE WHEN (SELECT count(*) FROM customer) >= 100 THEN 'pass' ELSE 'fail' END AS status UNION ALL SELECT 'hazards', CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'error') >= 1000000000 THEN 'pass' ELSE 'fail' END
    UNION ALL SELECT 'replays', 'unevaluable'""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"customers": read_table(spark, sf_dir, "customer").count(), "hazards": event_frames(spark, sf_dir).filter("label = 'hazard'").count(), "replays": None}
    return spark.createDataFrame(list(experiment.quality_gates(counts, {"customers": 100, "hazards": 10**9, "replays": 1}).items()), "gate string, status string")


def _exact(source: str) -> str:
    """SQL of the exact binomial intervals of rows (g, n, k) of a source, as ends (g, n, k, low, high): by halving."""
    tail = lambda to, p: f"list_sum(list_transform(range(0, {to}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
    return f"""halved AS (SELECT g, n, k, 0 AS step, 0.0::DOUBLE AS la, 1.0::DOUBLE AS lb, 0.0::DOUBLE AS ua, 1.0::DOUBLE AS ub FROM {source}
      UNION ALL SELECT g, n, k, step + 1, CASE WHEN 1 - lt < 0.025 THEN (la + lb) / 2 ELSE la END, CASE WHEN 1 - lt < 0.025 THEN lb ELSE (la + lb) / 2 END, CASE WHEN ut > 0.025 THEN (ua + ub) / 2 ELSE ua END, CASE WHEN ut > 0.025 THEN ub ELSE (ua + ub) / 2 END FROM (
        SELECT *, coalesce({tail("k", "((la + lb) / 2)")}, 0) AS lt, coalesce({tail("k + 1", "((ua + ub) / 2)")}, 0) AS ut FROM halved WHERE step < 45)),
    ends AS (SELECT g, n, k, CASE WHEN k = 0 THEN 0.0 ELSE la END AS low, CASE WHEN k = n THEN 1.0 ELSE ua END AS high FROM halved WHERE step = 45)"""


@query(f"""WITH RECURSIVE c AS (SELECT c_mktsegment AS g, count(*) AS n, count(*) FILTER (c_acctbal > 9500) AS k FROM customer GROUP BY 1), {_exact("c")}
    SELECT g AS c_mktsegment, n AS trials, k AS successes, round(k / n, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high FROM ends""")
def binomial_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with their exact binomial intervals."""
    rows = read_table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("trials"), F.count_if(F.col("c_acctbal") > 9500).alias("successes"))
    out = resample.binomial_records(rows)
    return out.select("c_mktsegment", "trials", "successes", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("SELECT n_nationkey, CAST(ceil(ln(0.05) / ln(1 - (n_nationkey + 1) / 100)) AS BIGINT) AS sequences FROM nation")
def zero_failure_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences without failure that put its probability under p, for a p of each row."""
    p = (F.col("n_nationkey") + 1) / 100
    return read_table(spark, sf_dir, "nation").select("n_nationkey", experiment.zero_failure_column(p).alias("sequences"))


@query("""WITH m AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS t, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS sample_id, o_custkey % 3 <> 0 AS says FROM orders GROUP BY o_custkey)
    SELECT array_to_string(list(sample_id ORDER BY sample_id) FILTER (t <> says)[1:5], ',') AS examples, count(*) AS n_rows, count(*) FILTER (t <> says) AS n_mismatch, round(avg(CASE WHEN t <> says THEN 1.0 ELSE 0.0 END), 6) AS rate FROM m""")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against what the mixture holds: mismatches, their rate, and the first five."""
    rows = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("c")).withColumn("sample_id", F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    out = audit.label_integrity(rows, F.col("c"), ["F"], F.when(F.col("o_custkey") % 3 != 0, "hazard").otherwise("benign"))
    return out.select(F.array_join("examples", ",").alias("examples"), "n_rows", "n_mismatch", F.round("rate", 6).alias("rate"))


_SIGNAL = "sig AS (SELECT event_id, event_type = 'error' AS y, value AS d, CASE WHEN event_type = 'error' THEN value / 50 ELSE 0 END + (event_id * 7919 % 1000) / 500 AS s FROM events)"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("event_type") == "error"
    noise = (F.col("event_id") * 7919 % 1000) / 500
    return read_table(spark, sf_dir, "events").select("event_id", y.alias("y"), F.col("value").alias("d"), (F.when(y, F.col("value") / 50).otherwise(0) + noise).alias("s"))


def _areas(group: str, source: str) -> str:
    return f"""a0 AS (SELECT {group}, s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM {source} GROUP BY ALL),
    a1 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY {group} ORDER BY s DESC) AS tp, sum(pos + neg) OVER (PARTITION BY {group} ORDER BY s DESC) AS seen FROM a0),
    areas AS (SELECT {group}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END AS auc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / seen) / sum(pos) END AS ap FROM a1 GROUP BY 1)"""


_BINNED = f"""WITH {_SIGNAL}, e AS (SELECT quantile_cont(d, [0, 0.25, 0.5, 0.75, 1]) AS e FROM sig WHERE y),
    dealt AS (SELECT CASE WHEN d >= e[4] THEN 3 WHEN d >= e[3] THEN 2 WHEN d >= e[2] THEN 1 ELSE 0 END AS bin, s, y FROM sig, e WHERE y UNION ALL SELECT unnest([0, 1, 2, 3]), s, y FROM sig WHERE NOT y), {_areas("bin", "dealt")}"""


@query(_BINNED + "SELECT CAST(bin AS INTEGER) AS bin, n_pos, n_neg, round(auc, 6) AS auc, round(e[bin + 1], 6) AS lower, coalesce(auc >= 0.8, false) AS passes FROM areas, e")
def detectability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the hazards of each bin of strength against all benign rows, and whether it meets the gate."""
    out = audit.detectability_bins(_signal(spark, sf_dir), "d", "s", F.col("y"), 4, 0.8)
    return out.select("bin", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("lower", 6).alias("lower"), "passes")


@query(_BINNED + "SELECT round(arg_min(auc, bin), 6) AS first, round(arg_max(auc, bin), 6) AS last, arg_max(auc, bin) - arg_min(auc, bin) >= 0.05 AS tracks_detectability FROM areas")
def detectability_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.trend(audit.detectability_bins(_signal(spark, sf_dir), "d", "s", F.col("y"), 4, 0.8))
    return out.select(F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "tracks_detectability")


_ENVELOPE = f"""WITH {_SIGNAL}, levels AS (SELECT unnest([0.0, 20.0, 60.0, 120.0]) AS level), dealt AS (SELECT level, s, y FROM sig, levels WHERE NOT y OR d >= level), {_areas("level", "dealt")},
    env AS (SELECT level::DOUBLE AS level, n_pos, n_neg, auc, n_pos / (SELECT count(*) FROM sig WHERE y) AS retained, coalesce(auc >= 0.8, false) AS passes FROM areas)"""


@query(_ENVELOPE + "SELECT level, n_pos, n_neg, round(auc, 6) AS auc, round(retained, 6) AS retained, passes FROM env")
def envelope_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each level, benign rows and the hazards that reach it."""
    out = audit.envelope(_signal(spark, sf_dir), "d", "s", F.col("y"), [0.0, 20.0, 60.0, 120.0], 0.8)
    return out.select("level", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("retained", 6).alias("retained"), "passes")


@query(_ENVELOPE + "SELECT min(CASE WHEN passes THEN level END) AS level, count(*) FILTER (passes) AS n_passing FROM env")
def lowest_passing_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lowest_passing(audit.envelope(_signal(spark, sf_dir), "d", "s", F.col("y"), [0.0, 20.0, 60.0, 120.0], 0.8))


@query("""SELECT c_nationkey, CASE WHEN bad > 1 THEN 'label_provenance_bug' WHEN n < 45 THEN 'underpowered_inconclusive' WHEN c IS NULL OR c < 0.48 OR coalesce(c + 0.1 < 0.5, false) THEN 'ceiling_invalid'
    WHEN c - 0.1 <= 0.5 AND c + 0.1 >= 0.5 AND r - 0.02 > 0.5 AND NOT (n % 2 = 0) THEN 'no_grounded_separability_confound' WHEN c < 0.8 AND n % 3 = 0 THEN 'generative_subnoise' WHEN c >= 0.8 AND r < 0.8 THEN 'indicator_information_loss'
    WHEN c >= 0.8 AND r >= 0.8 THEN 'both_present' ELSE 'inconclusive' END AS verdict FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < -980) AS bad, avg(c_acctbal) / 6500 AS c, median(c_acctbal) / 7000 AS r FROM customer GROUP BY 1)""")
def ceiling_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict tree over one summary row for each nation."""
    customers = read_table(spark, sf_dir, "customer")
    rows = customers.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < -980).alias("bad"), (F.avg("c_acctbal") / 6500).alias("c"))
    rows = attach(rows, quantiles(customers, "c_acctbal", [0.5], ["c_nationkey"]), ["c_nationkey"]).withColumn("r", F.col("q")[0] / 7000)
    s = rows.select(
        "c_nationkey", F.when(F.col("bad") > 1, 1).otherwise(0).alias("n_mismatch"), (F.col("n") < 45).alias("underpowered"), F.col("c").alias("ceiling_auc"), (F.col("c") - 0.1).alias("ceiling_low"), (F.col("c") + 0.1).alias("ceiling_high"),
        F.col("r").alias("raw_auc"), (F.col("r") - 0.02).alias("raw_low"), (F.col("n") % 2 == 0).alias("tracks"), (F.col("n") % 3 == 0).alias("only_highest_pass"),
    )
    return audit.verdict(s).select("c_nationkey", "verdict")


_PROBES = sql("regimes", "").rstrip() + f""", probe AS (SELECT scenario_id, risk_score, (timestamp / 3600) % 24 AS hour, CAST(floor(timestamp / 86400) AS BIGINT) % 2 = 0 AS y FROM regimes),
    pooled AS (SELECT * FROM probe UNION ALL SELECT 'pooled', risk_score, hour, y FROM probe),
    long AS (SELECT scenario_id || '/risk_score' AS g, risk_score AS s, y FROM pooled UNION ALL SELECT scenario_id || '/hour', hour, y FROM pooled), {_areas("g", "long")}"""


@query(_PROBES + """SELECT split_part(g, '/', 1) AS scenario_id, split_part(g, '/', 2) AS probe, n_pos, n_neg, round(auc, 6) AS auc, round(ap, 6) AS average_precision,
    CASE WHEN n_pos < 20 OR n_neg < 20 THEN 'underpowered' WHEN auc IS NULL THEN 'unevaluable' ELSE 'evaluated' END AS status FROM areas""")
def separability_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of risk and hour by scenario and pooled."""
    frames = alarms.regime_frames(spark, sf_dir).withColumn("hour", (F.col("timestamp") / 3600) % 24)
    out = audit.probes(frames, ["risk_score", "hour"], F.floor(F.col("timestamp") / 86400) % 2 == 0)
    return out.select("scenario_id", "probe", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), "status")


@query("""SELECT o_orderstatus AS identity, decade, count(*) AS n, CAST(sum(CASE WHEN p > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN p > 100000 THEN 1.0 ELSE 0.0 END), 6) AS rate
    FROM (SELECT o_orderstatus, o_totalprice AS p, CAST(floor(log10(o_totalprice)) AS INTEGER) AS decade FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, decade), (o_orderstatus), (decade), ())""")
def detection_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by identity and decade, by each alone, and over all."""
    truth = read_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("identity"), F.floor(F.log10("o_totalprice")).cast("int").alias("decade"), "o_totalprice")
    out = audit.frontier(truth, F.col("o_totalprice") > 100000)
    return out.select("identity", "decade", "n", "hits", F.round("rate", 6).alias("rate"))


@query("""WITH p AS (SELECT l_returnflag AS detector, l_linenumber AS dose, avg(CASE WHEN l_quantity > 25 - 2 * l_linenumber THEN 1.0 ELSE 0.0 END) AS power FROM lineitem GROUP BY ALL)
    SELECT detector, min(CASE WHEN power >= 0.6 THEN dose END) AS first_dose, arg_max(dose, (power, -dose)) AS best FROM p GROUP BY 1""")
def dose_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least dose of enough power of each detector, and its best one."""
    hit = (F.col("l_quantity") > 25 - 2 * F.col("l_linenumber")).cast("double")
    power = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("detector"), F.col("l_linenumber").alias("dose")).agg(F.avg(hit).alias("power"))
    best = audit.remaining_best(power.withColumn("position", F.col("dose")), "power", ["detector"]).select("detector", F.col("dose").alias("best"))
    return audit.first_dose(power, 0.6).join(best, "detector").select("detector", "first_dose", "best")


_FLAG = "CASE l_returnflag WHEN 'A' THEN 'hazard_a' WHEN 'R' THEN 'hazard_b' ELSE 'water' END"


@query(f"""WITH f AS (SELECT l_orderkey, {_FLAG} AS c, (l_extendedprice + 1) / 77777 AS x, l_discount AS clip FROM lineitem),
    s AS (SELECT l_orderkey, list_sort(list_distinct(list(c) FILTER (c <> 'water'))) AS t, exp(avg(ln(x))) AS conc, max(clip) AS worst, median(clip) AS mid, count(*) AS n FROM f GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS sequence_id, CASE WHEN coalesce(len(t), 0) = 0 THEN 'none' ELSE array_to_string(t, '+') END AS identity, round(conc, 6) AS concentration, CAST(floor(log10(conc) + 1e-12) AS INTEGER) AS decade, worst AS max_clipping, round(mid, 6) AS median_clipping, n AS n_frames FROM s""")
def sequence_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of each sequence from latents and mixture in JSON: targets, concentration, decade, extremes of clipping."""
    from tidemark.sources import simulate

    name = F.when(F.col("l_returnflag") == "A", "hazard_a").when(F.col("l_returnflag") == "R", "hazard_b").otherwise("water")
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sequence_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("sample_id"), F.col("l_linenumber").cast("double").alias("timestamp"), F.col("l_discount").alias("clipping_fraction"),
        F.to_json(F.struct(((F.col("l_extendedprice") + 1) / 77777).alias("concentration"))).alias("latent_json"), F.to_json(F.struct(F.array(name, F.lit("background")).alias("components"), F.array(F.lit(0.7), F.lit(0.3)).alias("weights"))).alias("mixture_json"),
    )
    out = audit.ground_truth(rows, F.col("latent_json"), F.col("mixture_json"), list(simulate.HAZARDS))
    return out.select("sequence_id", "identity", F.round("concentration", 6).alias("concentration"), "decade", "max_clipping", F.round("median_clipping", 6).alias("median_clipping"), "n_frames")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
    m AS (SELECT vec_id, own, max(CASE WHEN own = other THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM m""")
def silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = density.silhouette(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count("*").alias("n"))


REFERENCES = 2000


@query(f"""WITH r AS (SELECT label < 3 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS x, row_number() OVER (PARTITION BY label < 3 ORDER BY sha256(CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR)) AS place FROM embeddings)
    SELECT CAST(h.place - 1 AS INTEGER) AS i, round(sum(list_distance(h.x, b.x) ** 2), 5) AS total, round(min(list_distance(h.x, b.x) ** 2), 6) AS nearest FROM r h, r b WHERE h.y AND NOT b.y AND h.place <= {REFERENCES} AND b.place <= {REFERENCES} GROUP BY 1""")
def squared_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared costs between the references of the classes, from norms and one product."""
    h, b = transport.references(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label") < 3, REFERENCES)
    cost = transport.squared_cost(h, b)
    rows = [(i, round(float(c.sum()), 5), round(float(c.min()), 6)) for i, c in enumerate(cost)]
    return spark.createDataFrame(rows, "i int, total double, nearest double")


@query(f"""WITH r AS (SELECT vec_id, label < 3 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS x, row_number() OVER (PARTITION BY label < 3 ORDER BY sha256(CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR)) AS place FROM embeddings),
    v AS (SELECT y, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM r WHERE place <= {REFERENCES}), m AS (SELECT i, avg(x) FILTER (y) AS h, avg(x) FILTER (NOT y) AS b FROM v GROUP BY 1),
    c AS (SELECT avg(q) FILTER (NOT y) - avg(q) FILTER (y) AS c FROM (SELECT y, list_dot_product(x, x) AS q FROM r WHERE place <= {REFERENCES})), e AS (SELECT vec_id, y, place, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM r),
    s AS (SELECT vec_id, any_value(place) AS place, 2 * sum(x * (h - b)) + any_value(c) AS s FROM e JOIN m USING (i), c GROUP BY 1)
    SELECT vec_id, round(s - (SELECT avg(s) FROM s WHERE place <= {REFERENCES}), 6) AS coordinate FROM s""")
def mean_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transport coordinate in its limit of class means, centred on the references."""
    rows = read_table(spark, sf_dir, "embeddings")
    h, b = transport.references(rows, "vec_id", "embedding", F.col("label") < 3, REFERENCES)
    return transport.coordinate(rows, "embedding", transport.fit_coordinate(h, b, None), ["vec_id"]).select("vec_id", F.round("coordinate", 6).alias("coordinate"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 7777 AS s, l_discount AS c, 1 / (1 + 3 * l_discount) AS w, l_returnflag = 'R' AS y FROM lineitem), m AS (SELECT sum(w * s) FILTER (y) / sum(w) FILTER (y) AS b, sum(w * s) FILTER (NOT y) / sum(w) FILTER (NOT y) AS a FROM r),
    v AS (SELECT greatest(avg(w * (s - CASE WHEN y THEN b ELSE a END) ** 2), 1e-6) AS v FROM r, m) SELECT l_orderkey, l_linenumber, round((b - a) * (s - (a + b) / 2) / (v * (1 + 3 * c)) * 1000, 3) AS llr FROM r, m, v""")
def emission_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted class means and a common variance, and the log likelihood ratio they give, less where reliability is."""
    rows = read_table(spark, sf_dir, "lineitem").withColumns({"s": F.col("l_extendedprice") / 7777, "c": F.col("l_discount")})
    state = transport.fit_emission(rows, "s", "c", F.col("l_returnflag") == "R", 3.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(transport.emission_llr(F.col("s"), F.col("c"), state) * 1000, 3).alias("llr"))


_ROOT = [round(1 + 0.01 * k, 2) for k in range(64)]


@query(f"""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE * sqrt(1 + 0.01 * (generate_subscripts(embedding, 1) - 1)) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM v WHERE label < 3 GROUP BY 1),
    d AS (SELECT vec_id, any_value(label) AS label, sqrt(sum((x - m) ** 2)) AS d FROM v JOIN m USING (i) GROUP BY 1), q AS (SELECT quantile_cont(d, 0.5) AS c1, quantile_cont(d, 0.75) AS c2, quantile_cont(d, 0.9) AS c3 FROM d WHERE label < 3)
    SELECT vec_id, round(d, 6) AS distance, CASE WHEN d <= c1 THEN 'trusted' WHEN d <= c2 THEN 'ambiguous' WHEN d <= c3 THEN 'degraded' ELSE 'high_risk' END AS regime_label, round(least(greatest((d - c1) / greatest(c3 - c1, 1e-12), 0), 1), 6) AS risk_score FROM d, q""")
def weighted_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted Euclidean distance from the hazards over all dimensions, fitted, frozen, loaded and applied."""
    rows = read_table(spark, sf_dir, "embeddings")
    state = regimes.load(regimes.dump(regimes.fit_distance(rows, "embedding", 64, F.col("label") < 3, _ROOT, "euclidean")))
    scored = rows.withColumn("distance", regimes.distance(F.col("embedding"), state))
    out = regimes.apply_boundaries(scored, "distance", regimes.fit_boundaries(scored, "distance", F.col("label") < 3))
    return out.select("vec_id", F.round("distance", 6).alias("distance"), "regime_label", F.round("risk_score", 6).alias("risk_score"))


_TARGETS, _SHAPES = cone.design(GRID)
_FREE = np.eye(CHANNELS) - _SHAPES @ np.linalg.pinv(_SHAPES)
_QUIET = "raw AS (SELECT vec_id AS sample_id, label, generate_subscripts(embedding, 1) - 1 AS i, 0.5 + 0.8 * unnest(embedding)::DOUBLE AS y FROM embeddings)"


def _quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("sequence_id"), F.col("vec_id").cast("double").alias("timestamp"), "label",
        F.transform("embedding", lambda x: 0.5 + 0.8 * x.cast("double")).alias("spectrum"), F.lit(GRID.tolist()).alias("wavelengths"),
    )


@query(f"""WITH {_QUIET}, {_matrix("free", _FREE)}, r AS (SELECT sample_id, free.i AS channel, sum(w * y) AS r FROM raw JOIN free ON raw.i = free.j WHERE label >= 3 GROUP BY ALL)
    SELECT CAST(channel AS INTEGER) AS channel, count(*) AS n, round(greatest(var_samp(r), 1e-8), 9) AS variance FROM r GROUP BY 1""")
def residual_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of each channel over benign spectra with the nuisance shapes taken out."""
    state = cone.fit(_quiet(spark, sf_dir).filter("label >= 3"))
    rows = [(k, n, round(v, 9)) for k, (n, v) in enumerate(zip(state["counts"], state["variance"]))]
    return spark.createDataFrame(rows, "channel int, n long, variance double")


_SCALE = 50.0  # one over the square root of a variance of 0.0004
_Q = np.linalg.qr(_SHAPES * _SCALE)[0]
_PROJECT = (np.eye(CHANNELS) - _Q @ _Q.T) * _SCALE
_T = _PROJECT @ _TARGETS
_G = _T.T @ _T
_INV = np.linalg.inv(_G)


@query(f"""WITH {_QUIET}, {_matrix("p", _PROJECT)}, {_table("t", "i, a, b", [(i, float(_T[i, 0]), float(_T[i, 1])) for i in range(CHANNELS)])}, y AS (SELECT sample_id, p.i AS i, sum(w * y) AS y FROM raw JOIN p ON raw.i = p.j GROUP BY ALL),
    d AS (SELECT sample_id, sum(y * y) AS yy, sum(a * y) AS da, sum(b * y) AS db FROM y JOIN t USING (i) GROUP BY 1),
    k AS (SELECT *, greatest(da, 0) ** 2 / {float(_G[0, 0])!r} AS ga, greatest(db, 0) ** 2 / {float(_G[1, 1])!r} AS gb, {float(_INV[0, 0])!r} * da + {float(_INV[0, 1])!r} * db AS x, {float(_INV[1, 0])!r} * da + {float(_INV[1, 1])!r} * db AS z FROM d)
    SELECT CAST(sample_id AS VARCHAR) AS sample_id, round(0.5 * greatest(ga, gb, CASE WHEN x >= 0 AND z >= 0 THEN x * da + z * db ELSE 0 END), 5) AS log_lr, {CHANNELS} AS n_valid, 'scored' AS status FROM k""")
def frozen_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for non-negative amounts of two targets under a frozen variance: the better of four active sets."""
    state = {"wavelengths": GRID.tolist(), "variance": [1 / _SCALE**2] * CHANNELS, "counts": [2] * CHANNELS}
    return cone.score(_quiet(spark, sf_dir), state).select("sample_id", F.round("log_lr", 5).alias("log_lr"), "n_valid", "status")


@query("""WITH m AS (SELECT o_custkey, arg_max(o_orderstatus, (o_totalprice, -ascii(o_orderstatus))) AS dominant, sum(o_totalprice) AS t FROM orders GROUP BY 1)
    SELECT c_mktsegment AS label, dominant, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, round(stddev_pop(c_acctbal), 6) AS std FROM customer JOIN m ON c_custkey = o_custkey GROUP BY ALL""")
def shift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by label and dominant component."""
    best = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_totalprice", -F.ascii("o_orderstatus"))).alias("dominant"))
    rows = read_table(spark, sf_dir, "customer").join(best, "c_custkey").withColumnRenamed("c_mktsegment", "label")
    return report.shift_summary(rows, "c_acctbal", ["label", "dominant"])


@query(sql("actions", """SELECT count(*) AS n_rows, count(DISTINCT sequence_id) AS n_sequences, count(*) FILTER (action = 'CONFIRM') AS n_confirm, count(*) FILTER (action = 'RESCAN') AS n_rescan,
    arg_max(action, (sequence_id, timestamp, sample_id)) AS latest_action, arg_max(sample_id, (sequence_id, timestamp, sample_id)) AS latest_sample FROM actions"""))
def report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(alarms.action_frames(spark, sf_dir)).drop("first_time", "last_time")


@query(sql("actions", """SELECT '# Supervisor report' || chr(10) || chr(10) || count(DISTINCT sequence_id) || ' sequences, ' || count(*) FILTER (action = 'CONFIRM') || ' confirmed rows, latest ' || arg_max(action, (sequence_id, timestamp, sample_id)) || '.' || chr(10) AS text,
    true AS grounded FROM actions"""))
def rendered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supervisor's report, rendered and held against the summary it is made of."""
    text = report.reports(alarms.action_frames(spark, sf_dir))["supervisor"]
    return spark.createDataFrame([(text, True)], "text string, grounded boolean")


@query(r"""WITH r AS (SELECT n_nationkey, n_name, n_nationkey / 7 AS x FROM nation) SELECT 'markdown' AS kind, '| n_nationkey | n_name | x |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || printf('%.6f', x) || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM r
    UNION ALL SELECT 'latex', '\begin{tabular}{lll}' || chr(10) || '\hline' || chr(10) || 'n\_nationkey & n\_name & x \\' || chr(10) || '\hline' || chr(10) || string_agg(n_nationkey || ' & ' || replace(n_name, '_', '\_') || ' & ' || printf('%.6f', x) || ' \\', chr(10) ORDER BY n_nationkey) || chr(10) || '\hline' || chr(10) || '\end{tabular}' || chr(10) FROM r""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables as Markdown and LaTeX, six decimals, escaped."""
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") / 7).alias("x")).orderBy("n_nationkey")
    return spark.createDataFrame([("markdown", sinks.markdown_table(rows)), ("latex", sinks.latex_table(rows))], "kind string, text string")


@query(sql("actions", """SELECT scenario_id, split, label, count(*) AS n, count(*) FILTER (action = 'CONFIRM') AS n_confirm, count(*) FILTER (action = 'RESCAN') AS n_rescan, round(avg(CASE WHEN action = 'HOLD' THEN 1.0 ELSE 0.0 END), 6) AS share_held,
    CASE WHEN split = 'unavailable' THEN 'no split assignment' ELSE '' END AS note FROM (SELECT f.scenario_id, CASE WHEN CAST(a.sequence_id AS BIGINT) % 5 = 0 THEN 'unavailable' ELSE a.split END AS split, a.label, a.action FROM actions a JOIN frames f USING (sample_id)) GROUP BY ALL"""))
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a run by scenario, split and label, where an assignment lacks every fifth sequence."""
    actions = alarms.action_frames(spark, sf_dir)
    ids = actions.select(F.col("sequence_id").alias("id"), "split").distinct().filter("cast(id AS long) % 5 <> 0")
    out = experiment.diagnose(actions.drop("split"), ids, "sequence_id")
    return out.withColumn("share_held", F.round("share_held", 6))


@query(_ARMS + "SELECT method, split, n_events, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM met WHERE method <> 'N2' UNION ALL SELECT 'reloaded', split, n_events, " + ", ".join(f"round({c}, 6)" for c in _METRICS) + " FROM met_N2")
def reloaded_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished run is saved, and read again under its configuration and split to stand beside baselines."""
    from tidemark.sources.frames import scratch

    path, config = scratch(spark, "run"), {"arm": "N2", "window": 5}
    rows = arm_rows(spark, sf_dir).select("method", "split", "n_events", *_METRICS)
    experiment.save_run(path, config, "test", {"metrics": rows.filter("method = 'N2'")})
    kept = experiment.reload_run(spark, path, config, "test")["metrics"].withColumn("method", F.lit("reloaded"))
    return rows.filter("method <> 'N2'").unionByName(kept).select("method", "split", "n_events", *[F.round(c, 6).alias(c) for c in _METRICS])


_READS = """r AS (SELECT l_returnflag AS sigma, l_linenumber AS gain, l_quantity AS truth, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_quantity * (1 + l_linenumber / 100) + l_tax END AS read FROM lineitem),
    c AS (SELECT sigma, gain, regr_slope(read, truth) AS slope, sqrt(avg((read - truth) ** 2)) AS rmse, count(*) - count(read) AS invalid, count(*) AS n FROM r GROUP BY ALL)"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.when(F.col("l_discount") > 0.09, F.lit(float("nan"))).otherwise(F.col("l_quantity") * (1 + F.col("l_linenumber") / 100) + F.col("l_tax"))
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sigma"), F.col("l_linenumber").alias("gain"), F.col("l_quantity").alias("truth"), read.alias("read"))


@query(f"WITH {_READS} SELECT sigma, gain, round(slope, 6) AS slope, round(rmse, 6) AS rmse, invalid, n FROM c")
def calibration_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and error of reads against the truth under each condition, and reads that are not valid."""
    out = probes.calibrated(_reads(spark, sf_dir), ["sigma", "gain"])
    return out.select("sigma", "gain", F.round("slope", 6).alias("slope"), F.round("rmse", 6).alias("rmse"), "invalid", "n")


@query(f"WITH {_READS} SELECT sigma, max(CASE WHEN rmse <= 1.2 THEN gain END) AS tolerated_gain FROM c GROUP BY 1")
def tolerated_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest gain error at which the read is still within the limit."""
    return probes.tolerance(probes.calibrated(_reads(spark, sf_dir), ["sigma", "gain"]), 1.2)


@query("""WITH r AS (SELECT l_returnflag AS detector, (l_linenumber - 1) / 10 AS dose, l_quantity + 8 * l_linenumber + l_discount AS score FROM lineitem), c AS (SELECT detector, quantile_cont(score, 0.95) AS cut FROM r WHERE dose = 0 GROUP BY 1)
    SELECT detector, dose::DOUBLE AS dose, round(avg(CASE WHEN score > cut THEN 1.0 ELSE 0.0 END), 6) AS power FROM r JOIN c USING (detector) WHERE dose > 0 GROUP BY ALL""")
def power_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each detector at each dose, against its own quantile without a dose."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("detector"), ((F.col("l_linenumber") - 1) / 10).alias("dose"), (F.col("l_quantity") + 8 * F.col("l_linenumber") + F.col("l_discount")).alias("score"))
    return probes.power_curve(rows).select("detector", "dose", F.round("power", 6).alias("power"))


_A, _B, _BACK = probes._shapes()
_SOLVE = np.linalg.pinv(np.stack([_A, _B, *_BACK], 1))[:2]


@query(f"""WITH v AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL),
    {_table("k", "i, a, b", [(i, float(_SOLVE[0, i]), float(_SOLVE[1, i])) for i in range(probes.CHANNELS)])} SELECT label, round(sum(a * x), 6) AS first, round(sum(b * x), 6) AS second FROM m JOIN k USING (i) GROUP BY 1""")
def analyte_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of two analytes in the mean spectrum of each family, the background projected out."""
    shape = f"label {read_table(spark, sf_dir, 'embeddings').schema['label'].dataType.simpleString()}, first double, second double"

    def one(pdf):
        x = np.array(pdf.sort_values("i")["x"])
        first, second = probes.read_amounts(x[None, :])
        return pdf.head(1)[["label"]].assign(first=first, second=second)

    cells = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").applyInPandas(one, shape).select("label", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


#: SQL of the points between which mass moves: centroids of labels, or all vectors.
_CENTROIDS = """v AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS id, label, i, avg(x) AS x FROM v GROUP BY ALL)"""
_VECTORS = """m AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def _sinkhorn(scale: float, steps: int, points: str = _CENTROIDS) -> str:
    """SQL of scaling between points of hazard labels and of the others, at scale times the median cost."""
    return f"""WITH RECURSIVE {points},
    c AS (SELECT a.id AS h, b.id AS b, sum((a.x - b.x) ** 2) AS c FROM m a JOIN m b USING (i) WHERE a.label < 3 AND b.label >= 3 GROUP BY ALL), e AS (SELECT {scale!r} * median(c) AS eps, count(DISTINCT h) AS n, count(DISTINCT b) AS m FROM c),
    rows_ AS (SELECT h, list(exp(-c / eps) ORDER BY b) AS k FROM c, e GROUP BY h), cols AS (SELECT b, list(exp(-c / eps) ORDER BY h) AS k FROM c, e GROUP BY b),
    k AS (SELECT (SELECT list(k ORDER BY h) FROM rows_) AS k, (SELECT list(k ORDER BY b) FROM cols) AS kt, eps, n, m FROM e),
    it AS (SELECT 0 AS t, list_transform(k, lambda r: 1.0::DOUBLE) AS u, list_transform(kt, lambda r: 1.0::DOUBLE) AS v, k, kt, eps, n, m FROM k
      UNION ALL SELECT t + 1, w, list_transform(kt, lambda r: 1.0 / m / list_dot_product(r, w)), k, kt, eps, n, m FROM (SELECT *, list_transform(k, lambda r: 1.0 / n / list_dot_product(r, v)) AS w FROM it WHERE t < {steps})),
    done AS (SELECT * FROM it WHERE t = {steps})"""


def _centroids(spark: SparkSession, sf_dir: str):
    cells = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").collect()  # a row for each label
    sides = [np.array([[x["x"] for x in r["v"]] for r in rows if (r["label"] < 3) == hazard]) for hazard in (True, False)]
    return (*sides, transport.squared_cost(*sides))


@query(_sinkhorn(0.1, 3000) + """, pairs AS (SELECT h, b, c, row_number() OVER (PARTITION BY b ORDER BY h) AS i, row_number() OVER (PARTITION BY h ORDER BY b) AS j FROM c)
    SELECT round(sqrt(sum(u[i] * exp(-c / eps) * v[j] * c)), 6) AS distance FROM pairs, done""")
def transport_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropic transport distance between the centroids of hazard labels and those of the others."""
    _, _, cost = _centroids(spark, sf_dir)
    return spark.createDataFrame([(round(transport.sinkhorn_w2(cost, 0.1 * float(np.median(cost)), 40_000), 6),)], "distance double")


@query(_sinkhorn(0.5, 3000) + """ SELECT 'hazard' AS side, CAST(unnest(range(n)) AS INTEGER) AS i, round(unnest(list_transform(u, lambda x: eps * (ln(x) - ln(u[1])))), 5) AS potential, true AS certified FROM done
    UNION ALL SELECT 'benign', CAST(unnest(range(m)) AS INTEGER), round(unnest(list_transform(v, lambda x: eps * (ln(x) + ln(u[1]) + ln(n * m)))), 5), true FROM done""")
def transport_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified potentials between the centroids, from Newton steps, with both marginals within the tolerance."""
    h, b, cost = _centroids(spark, sf_dir)
    eps = 0.5 * float(np.median(cost))
    found = transport.potentials(h, b, eps, 1e-10)
    met = transport.marginal_error(cost, np.array(found["f"]), np.array(found["g"]), eps) <= 1e-9
    rows = [(side, i, round(x, 5), bool(met)) for side, key in (("hazard", "f"), ("benign", "g")) for i, x in enumerate(found[key])]
    return spark.createDataFrame(rows, "side string, i int, potential double, certified boolean")


#: References of each class from which potentials start; where they end doesn't depend on it.
START = 100


def _solved(spark: SparkSession, sf_dir: str):
    """Both sides of `embeddings` as whole clouds, with their potentials at half the median cost of all pairs. References
    tell where to begin, with the median as with the potentials, and nothing else."""
    rows = read_table(spark, sf_dir, "embeddings")
    near = transport.references(rows, "vec_id", "embedding", F.col("label") < 3, REFERENCES)
    h, b = (clouds.cloud(rows.filter((F.col("label") < 3) == hazard), "vec_id", "embedding") for hazard in (True, False))
    eps = 0.5 * clouds.median_cost(h, b, tuple(np.quantile(transport.squared_cost(*near), (0.47, 0.53))))
    start = clouds.starting([side[:START] for side in near], eps, b)
    return h, b, *clouds.potentials(h, b, eps, start, 1e-8)[:2], eps


@query(_sinkhorn(0.5, 200, _VECTORS) + """, sides AS (SELECT h AS vec_id, 'hazard' AS side, row_number() OVER (ORDER BY h) AS i FROM (SELECT DISTINCT h FROM c) UNION ALL SELECT b, 'benign', row_number() OVER (ORDER BY b) FROM (SELECT DISTINCT b FROM c))
    SELECT vec_id, side, round(CASE side WHEN 'hazard' THEN eps * (ln(u[i]) - ln(u[1])) ELSE eps * (ln(v[i]) + ln(u[1]) + ln(n * m)) END, 5) AS potential FROM sides, done""")
def transport_of_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified potentials of every vector, zero at the first hazard, from costs made by blocks in tasks."""
    h, b, f, g, _ = _solved(spark, sf_dir)
    mine, theirs = clouds.by_point(h, f, "p"), clouds.by_point(b, g, "p")
    first = mine.orderBy("id").first()["p"]
    both = mine.select("id", F.lit("hazard").alias("side"), (F.col("p") - first).alias("p")).unionAll(theirs.select("id", F.lit("benign").alias("side"), F.col("p") + first))
    return both.select(F.col("id").alias("vec_id"), "side", F.round("p", 5).alias("potential"))


@query(_sinkhorn(0.5, 200, _VECTORS) + """, pairs AS (SELECT h, b, c, row_number() OVER (PARTITION BY b ORDER BY h) AS i, row_number() OVER (PARTITION BY h ORDER BY b) AS j FROM c)
    SELECT round(sqrt(sum(u[i] * exp(-c / eps) * v[j] * c)), 6) AS distance FROM pairs, done""")
def distance_of_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropic transport distance between all hazard vectors and all others."""
    return spark.createDataFrame([(round(clouds.distance(*_solved(spark, sf_dir)), 6),)], "distance double")


@query()
def coordinate_of_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transport coordinate of every vector by the potentials of all vectors, not of references."""
    h, b, f, g, eps = _solved(spark, sf_dir)
    rest = read_table(spark, sf_dir, "embeddings").filter("label IS NULL")
    rest = None if rest.isEmpty() else clouds.cloud(rest, "vec_id", "embedding")
    return clouds.coordinates(h, b, f, g, eps, rest).select(F.col("id").alias("vec_id"), F.round("coordinate", 6).alias("coordinate"))


@query(f"""WITH RECURSIVE c AS (SELECT 'benign' AS g, count(*) AS n, count(*) FILTER (s_acctbal > 9900) AS k FROM supplier UNION ALL SELECT p_brand || '|decade=-2', count(*), count(*) FILTER (p_retailprice > 1400) FROM part GROUP BY p_brand), {_exact("c")}
    SELECT CASE WHEN (SELECT low FROM ends WHERE g = 'benign') > 0.01 THEN 'UNFAVORABLE' WHEN (SELECT count(*) FROM ends WHERE g <> 'benign' AND n >= 10 AND low >= 0.5) > 0 THEN 'FAVORABLE'
      WHEN (SELECT bool_and(n >= 10 AND high <= 0.25) FROM ends WHERE g <> 'benign') THEN 'UNFAVORABLE' ELSE 'INCONCLUSIVE' END AS verdict, count(*) FILTER (g <> 'benign') AS cells FROM ends""")
def progression_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict from counts: false positives among benign sequences, and detections in each cell of targets."""
    benign = read_table(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") > 9900), F.count("*")).first()
    cells = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") > 1400).alias("k"), F.count("*").alias("n")).collect()  # a row for each brand
    found = {f"{r['p_brand']}|decade=-2": (r["k"], r["n"]) for r in cells}
    return spark.createDataFrame([(experiment.progression(tuple(benign), found, 120), len(found))], "verdict string, cells long")


_TWO = "x AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS y, l_quantity / 50 AS a, l_extendedprice / 100000 AS b FROM lineitem)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spectra of two channels."""
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("y"), F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000).alias("spectrum"))


@query(f"""WITH {_TWO}, m AS (SELECT y, avg(a) AS a, avg(b) AS b, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM x GROUP BY y), p AS (SELECT h, n FROM m h, m n WHERE h.y AND NOT n.y)
    SELECT round(sqrt((h.a - n.a) ** 2 + (h.b - n.b) ** 2 + greatest(h.aa + h.bb + n.aa + n.bb - 2 * sqrt(h.aa * n.aa + 2 * h.ab * n.ab + h.bb * n.bb + 2 * sqrt((h.aa * h.bb - h.ab ** 2) * (n.aa * n.bb - n.ab ** 2))), 0)), 4) AS distance FROM p""")
def gaussian_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport distance of two Gaussians with the classes' moments; SQL has the closed form for two dimensions."""
    from tidemark.operators.spectra import scatter

    moments = []
    for y in (True, False):
        n, total, outer = scatter(_two(spark, sf_dir).filter(F.col("y") == y), "spectrum")
        moments += [total / n, (outer - np.outer(total, total) / n) / (n - 1)]
    return spark.createDataFrame([(round(transport.gaussian_w2(*moments), 4),)], "distance double")


@query(f"""WITH {_TWO}, c AS (SELECT avg(a) AS a, avg(b) AS b, 0.9 * var_samp(a) + 0.1 * (var_samp(a) + var_samp(b)) / 2 + 1e-12 AS aa, 0.9 * var_samp(b) + 0.1 * (var_samp(a) + var_samp(b)) / 2 + 1e-12 AS bb, 0.9 * covar_samp(a, b) AS ab FROM x WHERE NOT y),
    w AS (SELECT a, b, (bb - 0.5 * ab) / (aa * bb - ab * ab) AS u, (0.5 * aa - ab) / (aa * bb - ab * ab) AS v FROM c)
    SELECT l_orderkey, l_linenumber, round(((x.a - w.a) * u + (x.b - w.b) * v) / sqrt(u + 0.5 * v), 5) AS score FROM x, w""")
def whitened_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched filter in the shrunk covariance of one class, applied to all; SQL inverts it for two channels."""
    from tidemark.operators.spectra import apply_filter, whitened_filter

    rows = _two(spark, sf_dir)
    out = apply_filter(rows, whitened_filter(rows.filter("NOT y"), np.array([1.0, 0.5])))
    return out.select("l_orderkey", "l_linenumber", F.round("filter_score", 5).alias("score"))
