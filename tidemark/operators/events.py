"""Alarm events: maximal runs of actions other than HOLD, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import finite
from tidemark.operators.quantiles import attach, quantiles
from tidemark.operators.ranges import cumulative, kept, text_key
from tidemark.operators.windows import in_order, remaining_time, toggle_rates, with_islands


def alarm_events(actions: DataFrame, flicker_below: float = 5.0, persistence_from: float = 5.0) -> DataFrame:
    """One row per run. An event is cleared by the HOLD behind it; null where the sequence ends with it.
    Short events are flicker unless their persistence reaches its threshold, or, where no finite
    persistence is known, unless they confirm."""
    has = set(actions.columns)
    label = F.col("label") if "label" in has else F.lit("")
    persistence = F.col("persistence_seconds").cast("double") if "persistence_seconds" in has else F.lit(None).cast("double")
    marked = with_islands(actions).withColumn("next_time", F.lead("timestamp").over(in_order()))
    order = F.struct("timestamp", "sample_id")
    runs = marked.filter("island IS NOT NULL").groupBy("sequence_id", "island").agg(
        F.min_by("sample_id", order).alias("start_sample_id"),
        F.max_by("sample_id", order).alias("end_sample_id"),
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
        F.min(F.when(F.col("action") == "CONFIRM", F.col("timestamp"))).alias("confirm_timestamp"),
        F.max_by("next_time", order).alias("clear_timestamp"),
        (F.max("score") if "score" in has else F.lit(None).cast("double")).alias("max_score"),
        F.max(F.when(finite(persistence), persistence)).alias("max_persistence"),
        F.bool_or(F.coalesce(label == "hazard", F.lit(False))).alias("is_hazard"),
    )
    confirmed = F.col("confirm_timestamp").isNotNull()
    duration = F.col("end_timestamp") - F.col("start_timestamp")
    known = F.col("max_persistence").isNotNull()
    met = F.when(known, F.col("max_persistence") >= persistence_from)
    return runs.select(
        "sequence_id", "island", "start_sample_id", "end_sample_id", "start_timestamp", "end_timestamp", "confirm_timestamp", "clear_timestamp",
        duration.alias("duration_seconds"), confirmed.alias("pred_confirmed"),
        (F.col("max_score") if "score" in has else confirmed.cast("double")).alias("event_score"),
        ((duration < flicker_below) & F.when(known, ~met).otherwise(~confirmed)).alias("is_flicker"),
        F.when(known, "persistence_threshold").otherwise("confirm_time_fallback_no_persistence").alias("flicker_rule"),
        met.alias("persistence_met_threshold"), "is_hazard",
    )


def numbered(events: DataFrame) -> DataFrame:
    """Global numbers ev_000000 in order of sequence and start. Sequences are counted first, so what
    is ordered as a whole is one row each, in ranges."""
    each = events.groupBy("sequence_id").agg(F.count("*").alias("n"))
    offsets = cumulative(each, "sequence_id", {"offset": F.col("n")}, current=False, number=text_key(F.col("sequence_id"))).select("sequence_id", "offset")
    own = F.row_number().over(Window.partitionBy("sequence_id").orderBy("island"))
    return events.withColumn("own", own).join(offsets, "sequence_id").withColumn(
        "event_id", F.concat(F.lit("ev_"), F.lpad((F.col("offset") + F.col("own") - 1).cast("string"), 6, "0"))
    ).drop("own", "offset")


def _share(part: Column, whole: Column, empty: float | None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def event_rates(events: DataFrame, by: list[str] = (), empty_fcr: float | None = 0.0, empty_mcr: float | None = 1.0) -> DataFrame:
    """False and missed confirm rates and time to confirm. Without events of a kind the rates are 0 and 1,
    or null where asked for."""
    benign, hazard = ~F.col("is_hazard"), F.col("is_hazard")
    ttc = F.when(hazard & F.col("pred_confirmed"), F.col("confirm_timestamp") - F.col("start_timestamp"))
    late = F.when(benign & F.col("pred_confirmed"), F.col("confirm_timestamp") - F.col("start_timestamp"))
    by = list(by)
    events = kept(events.select(*by, "is_hazard", "pred_confirmed", "is_flicker", ttc.alias("__ttc"), late.alias("__late")))
    rows = events.groupBy(*by).agg(
        F.count("*").alias("n_events"), F.count_if(hazard).alias("n_hazard_events"), F.count_if(benign).alias("n_benign_events"),
        F.count_if(benign & F.col("pred_confirmed")).alias("benign_confirmed"), F.count_if(hazard & F.col("pred_confirmed")).alias("hazard_confirmed"),
        F.count_if(F.col("is_flicker") & F.col("pred_confirmed")).alias("flicker_confirm_count"),
    )
    # an event has one of the two delays at most: both are one table of values
    delays = events.select(*by, F.col("__ttc").isNotNull().alias("__hit"), F.coalesce("__ttc", "__late").alias("__delay"))
    q = quantiles(delays, "__delay", [0.25, 0.5, 0.75], [*by, "__hit"])
    rows = attach(attach(rows, q.filter("__hit"), by, "__t"), q.filter("NOT __hit"), by, "__l")
    rows = rows.withColumns({"median_ttc": F.col("__t")[1], "iqr_ttc": F.col("__t")[2] - F.col("__t")[0], "false_confirm_latency_median": F.col("__l")[1]}).drop("__t", "__l")
    missed = None if empty_mcr is None else 1 - empty_mcr
    return rows.withColumns({
        "fcr": _share(F.col("benign_confirmed"), F.col("n_benign_events"), empty_fcr),
        "mcr": 1 - _share(F.col("hazard_confirmed"), F.col("n_hazard_events"), missed),
    })


def suppression(actions: DataFrame, by: list[str] = ()) -> DataFrame:
    return actions.groupBy(*by).agg((1 - F.avg((F.col("action") != "HOLD").cast("double"))).alias("suppression_efficiency"))


def persistence_errors(actions: DataFrame) -> DataFrame:
    """RMSE and MAE of persistence_seconds against the remaining time of the run."""
    gap = F.col("persistence_seconds") - F.col("remaining")
    return remaining_time(actions).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def per_sequence(actions: DataFrame, events: DataFrame) -> DataFrame:
    """What resampling of sequences needs: toggle rate and event counts of each."""
    benign, hazard = ~F.col("is_hazard"), F.col("is_hazard")
    counts = events.groupBy("sequence_id").agg(
        F.count_if(benign).alias("benign_events"), F.count_if(benign & F.col("pred_confirmed")).alias("benign_confirmed"),
        F.count_if(hazard).alias("hazard_events"), F.count_if(hazard & F.col("pred_confirmed")).alias("hazard_confirmed"),
    )
    return toggle_rates(actions).join(counts, "sequence_id", "left").fillna(0, ["benign_events", "benign_confirmed", "hazard_events", "hazard_confirmed"])
