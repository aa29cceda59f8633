"""Queries on alarms: splits, regimes, actions, events, sequence windows and folds, over `events`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, scalars
from tidemark.operators import contracts, events, folds, metrics, regimes, windows
from tidemark.operators.quantiles import quantiles
from tidemark.plans.registry import query, sql
from tidemark.sources.frames import event_frames



def _hazard() -> Column:
    return F.col("label") == "hazard"


def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).withColumn("split", keys.split_of(F.col("sequence_id")))


def regime_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with regimes; boundaries come from the hazards of the training split alone."""
    frames = split_frames(spark, sf_dir)
    cuts = regimes.fit_boundaries(frames.filter("split = 'train'"), "score", _hazard())
    return regimes.apply_boundaries(frames, "score", cuts)


def action_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N of M (3 of 5) on the risk score."""
    frames = regime_frames(spark, sf_dir).withColumn("score", F.col("risk_score"))
    return windows.n_of_m(frames, 3, 5, 0.5)


@query(sql("alarms", """SELECT 'ev_' || lpad(CAST(row_number() OVER (ORDER BY sequence_id, island) - 1 AS VARCHAR), 6, '0') AS event_id, sequence_id, split,
    start_sample_id, end_sample_id, round(end_timestamp - start_timestamp, 3) AS duration_seconds, confirm_timestamp IS NOT NULL AS pred_confirmed,
    round(CASE WHEN cleared THEN clear_timestamp - end_timestamp END, 3) AS clear_after, round(event_score, 6) AS event_score,
    (end_timestamp - start_timestamp < 5) AND confirm_timestamp IS NULL AS is_flicker, is_hazard FROM alarms"""))
def alarm_events_nofm(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = action_frames(spark, sf_dir)
    found = events.numbered(events.alarm_events(actions))
    return found.select(
        "event_id", "sequence_id", keys.split_of(F.col("sequence_id")).alias("split"), "start_sample_id", "end_sample_id",
        F.round("duration_seconds", 3).alias("duration_seconds"), "pred_confirmed",
        F.round(F.col("clear_timestamp") - F.col("end_timestamp"), 3).alias("clear_after"), F.round("event_score", 6).alias("event_score"), "is_flicker", "is_hazard",
    )


@query(sql("alarms", """SELECT split, count(*) AS n_events, count(*) FILTER (is_hazard) AS n_hazard_events, count(*) FILTER (NOT is_hazard) AS n_benign_events,
    round(CASE WHEN count(*) FILTER (NOT is_hazard) > 0 THEN count(*) FILTER (NOT is_hazard AND confirm_timestamp IS NOT NULL) / count(*) FILTER (NOT is_hazard) ELSE 0.0 END, 6) AS fcr,
    round(1 - CASE WHEN count(*) FILTER (is_hazard) > 0 THEN count(*) FILTER (is_hazard AND confirm_timestamp IS NOT NULL) / count(*) FILTER (is_hazard) ELSE 0.0 END, 6) AS mcr,
    round(quantile_cont(confirm_timestamp - start_timestamp, 0.5) FILTER (is_hazard), 3) AS median_ttc,
    round((quantile_cont(confirm_timestamp - start_timestamp, 0.75) FILTER (is_hazard)) - (quantile_cont(confirm_timestamp - start_timestamp, 0.25) FILTER (is_hazard)), 3) AS iqr_ttc
    FROM alarms GROUP BY split"""))
def alarm_metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.alarm_events(action_frames(spark, sf_dir)).withColumn("split", keys.split_of(F.col("sequence_id")))
    return events.event_rates(found, ["split"]).select(
        "split", "n_events", "n_hazard_events", "n_benign_events", F.round("fcr", 6).alias("fcr"), F.round("mcr", 6).alias("mcr"),
        F.round("median_ttc", 3).alias("median_ttc"), F.round("iqr_ttc", 3).alias("iqr_ttc"),
    )


@query(sql("actions", "SELECT split, round(1 - avg(CASE WHEN action <> 'HOLD' THEN 1.0 ELSE 0.0 END), 6) AS suppression_efficiency FROM actions GROUP BY split"))
def suppression_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.suppression(action_frames(spark, sf_dir), ["split"]).select("split", F.round("suppression_efficiency", 6).alias("suppression_efficiency"))


@query(sql("splits", "SELECT sequence_id, bucket, split FROM buckets JOIN splits USING (sequence_id)"))
def hash_split_mod1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = event_frames(spark, sf_dir).select("sequence_id").distinct()
    return ids.select("sequence_id", keys.bucket1000(F.col("sequence_id")).alias("bucket"), keys.split_of(F.col("sequence_id")).alias("split"))


@query(sql("frames", """SELECT sample_id, round(concat('0x', substr(sha256('123:' || sample_id), 1, 16))::UBIGINT / pow(2, 64), 9) AS fraction,
    concat('0x', substr(sha256('123:' || sample_id), 1, 16))::UBIGINT / pow(2, 64) < 0.8 AS is_train FROM frames"""))
def hash_split_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = keys.fraction(F.col("sample_id"), 123)
    return event_frames(spark, sf_dir).select("sample_id", F.round(f, 9).alias("fraction"), (f < 0.8).alias("is_train"))


@query(sql("frames", "SELECT sample_id, concat('0x', substr(sha256('fold|' || sample_id), 1, 8))::BIGINT AS seed FROM frames"))
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).select("sample_id", keys.derived_seed("fold", F.col("sample_id")).alias("seed"))


@query(sql("splits", """SELECT (SELECT count(*) FROM (SELECT sequence_id FROM frames JOIN splits USING (sequence_id) GROUP BY sequence_id HAVING count(DISTINCT split) > 1)) AS leaking_sequences,
    (SELECT count(*) FROM splits WHERE split = 'train') AS n_train, (SELECT count(*) FROM splits WHERE split = 'val') AS n_val, (SELECT count(*) FROM splits WHERE split = 'test') AS n_test"""))
def split_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = split_frames(spark, sf_dir).groupBy("sequence_id").agg(F.count_distinct("split").alias("k"), F.first("split").alias("split"))
    return per.agg(F.count_if(F.col("k") > 1).alias("leaking_sequences"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])


@query(sql("cuts", "SELECT round(c1, 6) AS trusted, round(c2, 6) AS ambiguous, round(c3, 6) AS degraded FROM cuts"))
def regime_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_frames(spark, sf_dir).filter((F.col("split") == "train") & _hazard())
    return quantiles(train, "score", regimes.QUANTILES).select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("trusted", "ambiguous", "degraded"))])


@query(sql("regimes", "SELECT sample_id, regime_label, round(risk_score, 6) AS risk_score FROM regimes"))
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime_frames(spark, sf_dir).select("sample_id", "regime_label", F.round("risk_score", 6).alias("risk_score"))


@query(sql("actions", """SELECT sequence_id, CAST(sum(changed) AS BIGINT) AS toggles, round(sum(changed) / greatest(max(timestamp) - min(timestamp), 1.0), 9) AS toggle_rate
    FROM (SELECT *, CASE WHEN action <> lag(action) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) THEN 1 ELSE 0 END AS changed FROM actions) GROUP BY sequence_id"""))
def toggle_rate_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.toggle_rates(action_frames(spark, sf_dir)).select("sequence_id", "toggles", F.round("toggle_rate", 9).alias("toggle_rate"))


_STATE = "CASE regime_label WHEN 'trusted' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END"


@query(sql("regimes", f"""SELECT sample_id, coalesce(e - lag(e) OVER w > 0.75, false) AS degrading_fast, coalesce(lag(s, 2) OVER w = s AND lag(s) OVER w <> s, false) AS oscillating,
    CASE WHEN e - lag(e) OVER w > 0.75 THEN 'degrading_fast' WHEN lag(s, 2) OVER w = s AND lag(s) OVER w <> s THEN 'boundary_oscillation' ELSE '' END AS transition_alert
    FROM (SELECT *, {_STATE} AS s, 3 * risk_score AS e FROM regimes) WINDOW w AS (PARTITION BY sequence_id ORDER BY timestamp, sample_id)"""))
def transition_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.expectation_alerts(regime_frames(spark, sf_dir), F.col("risk_score") * 3, F.expr(_STATE))
    has = lambda c: F.array_contains("alert_codes", c)
    return out.select("sample_id", has("DEGRADING_FAST").alias("degrading_fast"), has("BOUNDARY_OSCILLATION").alias("oscillating"), "transition_alert")


@query(sql("islands", """SELECT sample_id, round(CASE WHEN island IS NULL THEN 0 ELSE max(timestamp) OVER (PARTITION BY sequence_id, island) - timestamp END, 3) AS remaining FROM islands"""))
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remaining_time(action_frames(spark, sf_dir)).select("sample_id", F.round("remaining", 3).alias("remaining"))


@query(sql("actions", """SELECT sample_id, CAST(coalesce(sum(CASE WHEN action <> 'HOLD' THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS future_active FROM actions"""))
def future_active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.future_active(action_frames(spark, sf_dir)).select("sample_id", "future_active")


@query(sql("frames", """SELECT sample_id, CASE WHEN max(CASE WHEN score > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) = 1 THEN 'CONFIRM' WHEN score > 100 THEN 'RESCAN' ELSE 'HOLD' END AS action,
    round(min(CASE WHEN score > 200 THEN timestamp END) OVER (PARTITION BY sequence_id), 3) AS first_confirm FROM frames"""))
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.first_crossing(event_frames(spark, sf_dir), 200.0, 100.0)
    return out.select("sample_id", "action", F.round("first_confirm", 3).alias("first_confirm"))


@query(sql("frames", """SELECT sample_id, round(p - least(min(p) OVER w, 0), 6) AS cusum FROM (SELECT *, sum(score - 60) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) AS p FROM frames)
    WINDOW w AS (PARTITION BY sequence_id ORDER BY timestamp, sample_id)"""))
def cusum_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cusum(event_frames(spark, sf_dir), 60.0).select("sample_id", F.round("cusum", 6).alias("cusum"))


_LISTED = "listed AS (SELECT sequence_id, list(sample_id ORDER BY timestamp, sample_id) AS ids, list(score ORDER BY timestamp, sample_id) AS xs FROM frames GROUP BY sequence_id)"


def _recursive(columns: str, first: str, step: str, final: str) -> str:
    """SQL of a fold: a recursive walk over numbered frames."""
    return sql("frames", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    numbered AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) AS n FROM frames),
    walk AS (SELECT sequence_id, n, sample_id, score, {first} FROM numbered WHERE n = 1
      UNION ALL SELECT f.sequence_id, f.n, f.sample_id, f.score, {step} FROM walk w JOIN numbered f ON f.sequence_id = w.sequence_id AND f.n = w.n + 1)
    {final}"""


@query(_recursive("", "0.2 * score + 0.8 * score AS ewma, greatest(0.0, score - 60) AS cusum", "0.2 * f.score + 0.8 * w.ewma, greatest(0.0, w.cusum + f.score - 60)",
    "SELECT sample_id, round(ewma, 6) AS ewma, round(cusum, 6) AS cusum, CASE WHEN ewma >= 90 OR cusum >= 250 THEN 'CONFIRM' WHEN ewma >= 72 THEN 'RESCAN' ELSE 'HOLD' END AS action FROM walk"))
def ewma_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.ewma_cusum(event_frames(spark, sf_dir), 0.2, 60.0, 250.0, 90.0)
    return out.select("sample_id", F.round("ewma", 6).alias("ewma"), F.round("cusum", 6).alias("cusum"), "action")


@query(_recursive("", "CASE WHEN score >= 120 THEN 1 ELSE 0 END AS held", "CASE WHEN w.held > 0 AND f.score <= 30 AND w.held + 1 >= 3 THEN 0 WHEN w.held > 0 THEN w.held + 1 WHEN f.score >= 120 THEN 1 ELSE 0 END",
    "SELECT sample_id, CASE WHEN held > 0 THEN 'CONFIRM' WHEN score >= 30 THEN 'RESCAN' ELSE 'HOLD' END AS action FROM walk"))
def hysteresis_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.hysteresis(event_frames(spark, sf_dir), 120.0, 30.0, 3).select("sample_id", "action")


@query(_recursive("", "[CASE WHEN score >= 60 THEN 1 ELSE 0 END] AS recent, CASE WHEN score >= 60 AND 1 >= 3 THEN 2 ELSE 0 END AS cool, CASE WHEN score >= 60 THEN 'RESCAN' ELSE 'HOLD' END AS action",
    """list_slice(list_append(w.recent, CASE WHEN f.score >= 60 THEN 1 ELSE 0 END), -5, -1),
    CASE WHEN w.cool > 0 THEN w.cool - 1 WHEN list_sum(list_slice(list_append(w.recent, CASE WHEN f.score >= 60 THEN 1 ELSE 0 END), -5, -1)) >= 3 THEN 2 ELSE 0 END,
    CASE WHEN w.cool > 0 THEN 'HOLD' WHEN list_sum(list_slice(list_append(w.recent, CASE WHEN f.score >= 60 THEN 1 ELSE 0 END), -5, -1)) >= 3 THEN 'CONFIRM' WHEN f.score >= 60 THEN 'RESCAN' ELSE 'HOLD' END""",
    "SELECT sample_id, action FROM walk"))
def nofm_cooldown_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.n_of_m(event_frames(spark, sf_dir), 3, 5, 60.0, 2).select("sample_id", "action")


@query(_recursive("", "CASE WHEN score >= 300 THEN 0 WHEN score >= 80 THEN 1 ELSE 0 END AS confirms, CASE WHEN score < 300 AND score >= 30 THEN 1 ELSE 0 END AS rescans, 0 AS cool, CASE WHEN score >= 300 THEN 'HOLD' WHEN score >= 30 THEN 'RESCAN' ELSE 'HOLD' END AS action",
    """CASE WHEN f.score >= 300 THEN 0 WHEN f.score >= 80 THEN w.confirms + 1 ELSE 0 END,
    CASE WHEN f.score >= 300 THEN 0 WHEN f.score >= 80 AND w.confirms + 1 >= 2 THEN 0 WHEN f.score >= 30 THEN w.rescans + 1 ELSE 0 END,
    CASE WHEN f.score < 300 AND f.score >= 80 AND w.confirms + 1 >= 2 THEN 3 ELSE greatest(w.cool - 1, 0) END,
    CASE WHEN f.score >= 300 THEN 'HOLD' WHEN f.score >= 80 AND w.confirms + 1 >= 2 THEN 'CONFIRM' WHEN w.cool > 0 THEN 'CONFIRM' WHEN f.score >= 30 THEN 'RESCAN' ELSE 'HOLD' END""",
    "SELECT sample_id, action FROM walk"))
def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("score")
    frames = event_frames(spark, sf_dir).withColumns({"veto": x >= 300, "confirm_ok": x >= 80, "rescan_ok": x >= 30})
    return folds.policy(frames, confirm_steps=2, rescan_steps=1, cooldown=3).select("sample_id", "action")


@query(_recursive("", "(score - 50) / 50 AS odds", "(ln(0.1 + 0.9 * exp(w.odds)) - ln(0.9 + 0.1 * exp(w.odds))) + (f.score - 50) / 50",
    "SELECT sample_id, round(odds, 6) AS log_odds, round(1 / (1 + exp(-odds)), 6) AS posterior FROM walk"))
def two_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir).withColumn("score", (F.col("score") - 50) / 50)
    return folds.two_state_filter(frames, 0.1).select("sample_id", F.round("log_odds", 6).alias("log_odds"), F.round("posterior", 6).alias("posterior"))


@query(sql("frames", "SELECT sequence_id, round(max(score), 6) AS max_score, round(sum(score), 6) AS total, count(*) AS n_frames, count(*) = 60 AS complete FROM frames GROUP BY sequence_id"))
def sequence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    return windows.accumulate_horizon(frames, 60).join(windows.sequence_maximum(frames), "sequence_id").select(
        "sequence_id", F.round("max_score", 6).alias("max_score"), F.round("total", 6).alias("total"), "n_frames", "complete"
    )


@query(sql("actions", """SELECT label, action, coalesce(n, 0) AS n, round(CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY label) > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY label) ELSE 0 END, 6) AS rate
    FROM (SELECT * FROM (VALUES ('hazard'), ('benign')) a(label), (VALUES ('HOLD'), ('RESCAN'), ('CONFIRM')) b(action)) LEFT JOIN (SELECT label, action, count(*) AS n FROM actions GROUP BY ALL) USING (label, action)"""))
def label_action_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.action_rates(action_frames(spark, sf_dir), ["hazard", "benign"], ["HOLD", "RESCAN", "CONFIRM"])
    return out.select("label", "action", "n", F.round("rate", 6).alias("rate"))


@query(sql("actions", """SELECT label, count(*) FILTER (action = 'HOLD') AS n_hold, count(*) FILTER (action = 'RESCAN') AS n_rescan, count(*) FILTER (action = 'CONFIRM') AS n_confirm,
    round(count(*) FILTER (action = 'HOLD') / count(*), 6) AS share_hold, round(count(*) FILTER (action = 'RESCAN') / count(*), 6) AS share_rescan, round(count(*) FILTER (action = 'CONFIRM') / count(*), 6) AS share_confirm FROM actions GROUP BY label"""))
def action_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.action_pivot(action_frames(spark, sf_dir), ["HOLD", "RESCAN", "CONFIRM"])
    return out.select("label", *[c for c in out.columns if c.startswith("n_")], *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("share_")])


@query(sql("frames", """SELECT scenario_id, count(score) AS n, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS max, round(avg(score), 6) AS mean FROM frames GROUP BY scenario_id"""))
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.five_numbers(event_frames(spark, sf_dir), "score", ["scenario_id"])
    return out.select("scenario_id", "n", *[F.round(c, 6).alias(c) for c in ("min", "q25", "median", "q75", "max", "mean")])


@query(sql("frames", """SELECT quantile_cont(score, 0.0) AS q0, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75, quantile_cont(score, 1.0) AS q100 FROM frames"""))
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles(event_frames(spark, sf_dir), "score", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select(F.col("q")[0].alias("q0"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in ((1, "q25"), (2, "q50"), (3, "q75"))], F.col("q")[4].alias("q100"))


@query(sql("regimes", f"""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN e - lag(e) OVER w > 0.75 THEN 'DEGRADING_FAST' END, CASE WHEN lag(s, 2) OVER w = s AND lag(s) OVER w <> s THEN 'BOUNDARY_OSCILLATION' END], lambda x: x IS NOT NULL)) AS code
    FROM (SELECT *, {_STATE} AS s, 3 * risk_score AS e FROM regimes) WINDOW w AS (PARTITION BY sequence_id ORDER BY timestamp, sample_id)) GROUP BY code"""))
def reason_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.expectation_alerts(regime_frames(spark, sf_dir), F.col("risk_score") * 3, F.expr(_STATE))
    return out.select(F.explode("alert_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(sql("islands", """SELECT bin, round(avg(risk), 6) AS pred_mean, round(avg(remaining), 3) AS target_mean, count(*) AS n FROM (
    SELECT risk, remaining, CASE WHEN risk >= e[10] THEN 9 WHEN risk >= e[9] THEN 8 WHEN risk >= e[8] THEN 7 WHEN risk >= e[7] THEN 6 WHEN risk >= e[6] THEN 5 WHEN risk >= e[5] THEN 4 WHEN risk >= e[4] THEN 3 WHEN risk >= e[3] THEN 2 WHEN risk >= e[2] THEN 1 ELSE 0 END AS bin
    FROM (SELECT score AS risk, CASE WHEN island IS NULL THEN 0 ELSE max(timestamp) OVER (PARTITION BY sequence_id, island) - timestamp END AS remaining FROM islands),
    (SELECT quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM islands)) GROUP BY bin"""))
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.remaining_time(action_frames(spark, sf_dir))
    out = metrics.calibration_bins(rows, "score", "remaining")
    return out.select("bin", F.round("pred_mean", 6).alias("pred_mean"), F.round("target_mean", 3).alias("target_mean"), "n")


@query(sql("islands", """SELECT round(sqrt(avg(gap * gap)), 3) AS rmse, round(avg(abs(gap)), 3) AS mae FROM (SELECT 1000 * score - CASE WHEN island IS NULL THEN 0 ELSE max(timestamp) OVER (PARTITION BY sequence_id, island) - timestamp END AS gap FROM islands)"""))
def rmse_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = action_frames(spark, sf_dir).withColumn("persistence_seconds", 1000 * F.col("score"))
    return events.persistence_errors(actions).select(F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query("""WITH d AS (SELECT round(value / 5) AS p, (event_id * 7919) % 101 AS t, count(*) AS n FROM events GROUP BY ALL),
    pairs AS (SELECT sum(CASE WHEN a.p > b.p THEN a.n * b.n ELSE 0 END) AS c, sum(CASE WHEN a.p = b.p THEN a.n * b.n ELSE 0 END) AS e, sum(a.n * b.n) AS n FROM d a JOIN d b ON a.t > b.t)
    SELECT CAST(c AS BIGINT) AS concordant, CAST(e AS BIGINT) AS tied, CAST(n AS BIGINT) AS comparable, round((c + 0.5 * e) / n, 9) AS c_index FROM pairs""")
def c_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.round(F.col("value") / 5).alias("p"), F.expr("event_id * 7919 % 101").alias("t"))
    out = metrics.concordance(rows, "p", "t")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("concordant", "tied", "comparable")], F.round("c_index", 9).alias("c_index"))


@query(sql("frames", """SELECT count(*) AS n_rows, count(DISTINCT sequence_id) AS n_sequences, round(min(timestamp), 3) AS first_time, round(max(timestamp), 3) AS last_time,
    arg_max(sample_id, (sequence_id, timestamp, sample_id)) AS latest_sample FROM frames"""))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_distinct("sequence_id").alias("n_sequences"), F.round(F.min("timestamp"), 3).alias("first_time"),
        F.round(F.max("timestamp"), 3).alias("last_time"), F.max_by("sample_id", F.struct("sequence_id", "timestamp", "sample_id")).alias("latest_sample"),
    )


@query(sql("frames", """SELECT sample_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM frames"""))
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return event_frames(spark, sf_dir).select("sample_id", k.alias("k"), F.when(k % 2 == 0, "even").otherwise("odd").alias("parity"))


@query(sql("frames", """SELECT sample_id, upper(replace(replace(trim(scenario_id), '-', '_'), ' ', '_')) AS token, regexp_replace(printf('%.6f', round(score * 4) / 4), '\\.?0+$', '') AS score_text FROM frames"""))
def token_and_float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).select("sample_id", scalars.alert_token(F.col("scenario_id")).alias("token"), scalars.float_text(F.round(F.col("score") * 4) / 4).alias("score_text"))


@query(sql("frames", """SELECT count(*) AS n_rows, CAST(sum(CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN 1 ELSE 0 END) AS BIGINT) AS bad_score, CAST(sum(CASE WHEN timestamp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_timestamp FROM frames"""))
def finite_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violations(event_frames(spark, sf_dir), ["score", "timestamp"])


@query(sql("frames", """SELECT scenario_id, category, count(*) AS n FROM (SELECT f.scenario_id, CASE WHEN score <= 100 THEN 'absent' WHEN dow < 2 THEN 'early' WHEN dow < 5 THEN 'in_window' ELSE 'late' END AS category
    FROM (SELECT *, CAST(floor(timestamp / 86400) AS BIGINT) % 7 AS dow FROM frames) f) GROUP BY ALL"""))
def episode_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("timestamp") / 86400) % 7
    first = F.when(F.col("score") > 100, day)
    cat = scalars.episode_category(first, F.lit(2), F.lit(3))
    return event_frames(spark, sf_dir).select("scenario_id", cat.alias("category")).groupBy("scenario_id", "category").agg(F.count("*").alias("n"))
