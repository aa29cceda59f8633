"""Stateful stream operators run over `events` as a stream, held against the same SQL as the batch folds; and sinks
read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import hmm
from tidemark.plans import alarms, models
from tidemark.plans.registry import ORACLES, query, sql
from tidemark.sources import sinks
from tidemark.sources.frames import as_frames, read_table, scratch
from tidemark.streaming import ordered, stateful


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `events` as a stream of frames. A file, or a folder of them, is one batch."""
    kept = read_table(spark, sf_dir, "events")
    return as_frames(spark.readStream.schema(kept.schema).parquet(f"{sf_dir}/events.parquet*"))


#: Seconds by which rows of the replayed table are out of order, and the micro-batches it comes in.
LATENESS, BATCHES = 86_400.0, 3


def _replayed(spark: SparkSession, sf_dir: str, silence: float = 0.0) -> DataFrame:
    """The table `events` as a stream of frames in several batches, out of order by up to a day."""
    frames = as_frames(read_table(spark, sf_dir, "events")).drop("props")
    return ordered.replay(frames, LATENESS, BATCHES, silence)


def _run(spark: SparkSession, sf_dir: str, operator, score=None) -> DataFrame:
    frames = _replayed(spark, sf_dir)
    frames = frames if score is None else frames.withColumn("score", score)
    return ordered.split_late(ordered.run(frames, operator, f"{LATENESS} seconds"))[0]


@query(ORACLES["ewma_trace"].replace(", round(cusum, 6) AS cusum", ""))
def stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, stateful.ewma_cusum(0.2, 60.0, 250.0, 90.0)).select("sample_id", F.round("value", 6).alias("ewma"), "action")


@query(ORACLES["hysteresis_actions"])
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, stateful.hysteresis(120.0, 30.0, 3)).select("sample_id", "action")


@query(ORACLES["nofm_cooldown_actions"])
def stream_n_of_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, stateful.n_of_m(3, 5, 60.0, 2)).select("sample_id", "action")


@query(ORACLES["policy_actions"])
def stream_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, stateful.policy(80.0, 30.0, 300.0, 2, 1, 3)).select("sample_id", "action")


@query(ORACLES["two_state_filter"].replace("round(odds, 6) AS log_odds, ", ""))
def stream_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, stateful.two_state(0.1), (F.col("score") - 50) / 50).select("sample_id", F.round("value", 6).alias("posterior"))


_OBSERVED = "CASE event_type WHEN 'error' THEN 3 ELSE length(event_type) % 3 END"


@query(ORACLES["hmm_forward"][: ORACLES["hmm_forward"].rindex("SELECT")].replace("CASE regime_label WHEN 'trusted' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END AS obs", "CASE scenario_id WHEN 'error' THEN 3 ELSE length(scenario_id) % 3 END AS obs")
    + "SELECT sample_id, round(f0, 6) AS p0 FROM ahead")
def stream_chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered posterior of a chain, one frame at a time."""
    obs = F.when(F.col("scenario_id") == "error", 3).otherwise(F.length("scenario_id") % 3).cast("double")
    return _run(spark, sf_dir, stateful.chain(hmm.start()), obs).select("sample_id", F.round("value", 6).alias("p0"))


_RUNS = sql("frames", "").rstrip() + """, a AS (SELECT *, CASE WHEN score > 150 THEN 'CONFIRM' WHEN score > 60 THEN 'RESCAN' ELSE 'HOLD' END AS action FROM frames),
    o AS (SELECT *, CASE WHEN action <> 'HOLD' AND coalesce(lag(action) OVER w, 'HOLD') = 'HOLD' THEN 1 ELSE 0 END AS opens, lead(timestamp) OVER w AS after FROM a WINDOW w AS (PARTITION BY sequence_id ORDER BY timestamp, sample_id)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) AS island FROM o),
    e AS (SELECT sequence_id, arg_min(sample_id, (timestamp, sample_id)) AS start_sample_id, arg_max(sample_id, (timestamp, sample_id)) AS end_sample_id, round(min(CASE WHEN action = 'CONFIRM' THEN timestamp END), 3) AS confirm_timestamp, round(max(score), 6) AS max_score, count(after) = count(*) AS held
      FROM r WHERE action <> 'HOLD' GROUP BY sequence_id, island)"""


@query(_RUNS + " SELECT sequence_id, start_sample_id, end_sample_id, confirm_timestamp, max_score FROM e WHERE held")
def stream_alarm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarm events of a stream that the HOLD behind them ends; those the clock ends depend on when it is looked at."""
    action = F.when(F.col("score") > 150, "CONFIRM").when(F.col("score") > 60, "RESCAN").otherwise("HOLD")
    out = stateful.to_table(stateful.alarm_events(_stream(spark, sf_dir).withColumn("action", action), 3600.0))
    return out.filter("closed_by = 'hold'").select("sequence_id", "start_sample_id", "end_sample_id", F.round("confirm_timestamp", 3).alias("confirm_timestamp"), F.round("max_score", 6).alias("max_score"))


@query(sql("frames", "").rstrip() + """, a AS (SELECT *, CASE WHEN score > 150 THEN 'CONFIRM' WHEN score > 60 THEN 'RESCAN' ELSE 'HOLD' END AS action FROM frames),
    o AS (SELECT *, CASE WHEN action <> 'HOLD' AND (coalesce(lag(action) OVER w, 'HOLD') = 'HOLD' OR timestamp > lag(timestamp) OVER w + 3600) THEN 1 ELSE 0 END AS opens,
      coalesce(lead(action) OVER w = 'HOLD' AND lead(timestamp) OVER w <= timestamp + 3600, false) AS before_hold FROM a WINDOW w AS (PARTITION BY sequence_id ORDER BY timestamp, sample_id)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) AS island FROM o)
    SELECT sequence_id, arg_min(sample_id, (timestamp, sample_id)) AS start_sample_id, arg_max(sample_id, (timestamp, sample_id)) AS end_sample_id, round(max(score), 6) AS max_score,
    CASE WHEN arg_max(before_hold, (timestamp, sample_id)) THEN 'hold' ELSE 'silence' END AS closed_by FROM r WHERE action <> 'HOLD' GROUP BY sequence_id, island""")
def stream_alarm_events_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alarm events of a shuffled stream: ended by a HOLD, or by an hour without a frame."""
    action = F.when(F.col("score") > 150, "CONFIRM").when(F.col("score") > 60, "RESCAN").otherwise("HOLD")
    actions = _replayed(spark, sf_dir, 3600.0).withColumn("action", action)
    out = ordered.table(ordered.alarm_events(actions, 3600.0, f"{LATENESS} seconds"))
    return out.select("sequence_id", "start_sample_id", "end_sample_id", F.round("max_score", 6).alias("max_score"), "closed_by")


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by scenario and read back, one scenario after another by partition pruning."""
    from tidemark.sources.frames import discover_scenarios

    path = scratch(spark, "sink")
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")).withColumn("scenario_id", F.col("o_orderstatus"))
    sinks.write_parquet(rows, path, ("scenario_id",))
    parts = [discover_scenarios(spark, path, names) for names in (["F"], ["O", "P"])]
    return parts[0].union(parts[1]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink")
    sinks.write_csv(read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return spark.read.schema("c_custkey long, c_mktsegment string, c_acctbal double").option("header", True).csv(path)


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey / 4 END AS x FROM nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON in the shared folder: numbers that are not finite are null in it."""
    path = scratch(spark, "sink")
    rows = read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    sinks.write_json(f"{path}/nations.json", [{"name": r["n_name"], "x": float("nan") if r["n_nationkey"] % 5 == 0 else r["n_nationkey"] / 4} for r in rows])
    return spark.read.schema("name string, x double").option("multiLine", True).json(path)


@query("SELECT r_regionkey, r_name FROM region")
def suffix_checked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet alone, told by its suffix."""
    from tidemark.sources.frames import read_parquet_frame

    return read_parquet_frame(spark, f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


@query("""SELECT CAST(vec_id AS VARCHAR) AS sample_id, CASE WHEN label < 3 THEN 'hazard' ELSE 'benign' END AS label, len(embedding) AS channels, round(list_sum(list_transform(embedding, lambda x: 0.5 + x::DOUBLE)), 6) AS total FROM embeddings""")
def npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra as NumPy archives in the shared folder, written and read by tasks, without pickles."""
    from tidemark.plans.spectral_queries import spectrum_rows
    from tidemark.sources import archives

    archives.register(spark)
    path = scratch(spark, "sink")
    rows = spectrum_rows(spark, sf_dir).select(F.col("sample_id").cast("string"), F.col("label").cast("string"), "wavelengths", "spectrum")
    rows.write.format("npz").mode("append").save(path)
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)
    return spark.read.format("npz").load(path).select("sample_id", "label", F.size("spectrum").cast("long").alias("channels"), F.round(total, 6).alias("total"))
