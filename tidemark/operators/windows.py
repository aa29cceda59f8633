"""Sequence operators as window functions: toggles, islands, remaining time, alerts, N of M, CUSUM.

All take frames (sequence_id, timestamp, sample_id, ...) and keep one partitioning by sequence_id, so
several of them on the same frames share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.operators.ranges import cumulative

BY_TIME = ("timestamp", "sample_id")


def in_order() -> WindowSpec:
    return Window.partitionBy("sequence_id").orderBy(*BY_TIME)


def _so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def toggle_rates(actions: DataFrame) -> DataFrame:
    """Changes of action over the duration in seconds, at least one."""
    changed = actions.withColumn("changed", (F.col("action") != F.lag("action").over(in_order())).cast("long"))
    return changed.groupBy("sequence_id").agg(
        F.coalesce(F.sum("changed"), F.lit(0)).alias("toggles"),
        (F.coalesce(F.sum("changed"), F.lit(0)) / F.greatest(F.max("timestamp") - F.min("timestamp"), F.lit(1.0))).alias("toggle_rate"),
    )


def with_islands(actions: DataFrame) -> DataFrame:
    """island: number of the run of actions other than HOLD within its sequence, null on HOLD."""
    active = F.col("action") != "HOLD"
    opens = active & F.coalesce(F.lag("action").over(in_order()) == "HOLD", F.lit(True))
    return actions.withColumn("opens", opens.cast("long")).withColumn("island", F.when(active, F.sum("opens").over(_so_far()))).drop("opens")


def remaining_time(actions: DataFrame) -> DataFrame:
    """Seconds to the end of the current run, 0 on HOLD."""
    marked = with_islands(actions)
    last = F.max("timestamp").over(Window.partitionBy("sequence_id", "island"))
    return marked.withColumn("remaining", F.when(F.col("island").isNull(), 0.0).otherwise(last - F.col("timestamp")))


def future_active(actions: DataFrame) -> DataFrame:
    """Active rows still to come in the sequence."""
    ahead = in_order().rowsBetween(1, Window.unboundedFollowing)
    return actions.withColumn("future_active", F.coalesce(F.sum((F.col("action") != "HOLD").cast("long")).over(ahead), F.lit(0)))


def expectation_alerts(frames: DataFrame, expectation: Column, state: Column, step: float = 0.75) -> DataFrame:
    """degrading_fast when the expectation rises by more than step; boundary_oscillation on A-B-A of states.
    The first is the alert where both hold; both are in the codes."""
    w = in_order()
    marked = frames.withColumns({"__e": expectation, "__s": state})
    fast = F.coalesce(F.col("__e") - F.lag("__e").over(w) > step, F.lit(False))
    swing = F.coalesce((F.lag("__s", 2).over(w) == F.col("__s")) & (F.lag("__s", 1).over(w) != F.col("__s")), F.lit(False))
    out = marked.withColumns({"fast": fast, "swing": swing})
    return out.withColumns({
        "transition_alert": F.when(F.col("fast"), "degrading_fast").when(F.col("swing"), "boundary_oscillation").otherwise(""),
        "alert_codes": F.array_compact(F.array(F.when(F.col("fast"), "DEGRADING_FAST"), F.when(F.col("swing"), "BOUNDARY_OSCILLATION"))),
    }).drop("__e", "__s", "fast", "swing")


def n_of_m(frames: DataFrame, n: int, m: int, threshold: float) -> DataFrame:
    """CONFIRM when n of the last m scores reach the threshold, RESCAN when this one does. For a
    cooldown see `folds.n_of_m`."""
    over = (F.col("score") >= threshold).cast("long")
    recent = F.sum(over).over(in_order().rowsBetween(-(m - 1), 0))
    return frames.withColumn("action", F.when(recent >= n, "CONFIRM").when(over == 1, "RESCAN").otherwise("HOLD"))


def cusum(frames: DataFrame, k: float) -> DataFrame:
    """One-sided CUSUM of score - k in closed form: prefix sum less its running minimum, which is 0 at most."""
    prefix = frames.withColumn("__prefix", F.sum(F.col("score") - k).over(_so_far()))
    low = F.least(F.min("__prefix").over(_so_far()), F.lit(0.0))
    return prefix.withColumn("cusum", F.col("__prefix") - low).drop("__prefix")


def first_crossing(frames: DataFrame, confirm: float, rescan: float) -> DataFrame:
    """Absorbing CONFIRM once the score has crossed, RESCAN above the lower threshold; and the time of the
    first crossing."""
    crossed = F.max((F.col("score") > confirm).cast("int")).over(_so_far()) == 1
    first = F.min(F.when(F.col("score") > confirm, F.col("timestamp"))).over(Window.partitionBy("sequence_id"))
    return frames.withColumns({
        "action": F.when(crossed, "CONFIRM").when(F.col("score") > rescan, "RESCAN").otherwise("HOLD"),
        "first_confirm": first,
    })


def sequence_maximum(frames: DataFrame) -> DataFrame:
    return frames.groupBy("sequence_id").agg(F.max("score").alias("max_score"))


def accumulate_horizon(frames: DataFrame, horizon: int) -> DataFrame:
    """Sum of scores per sequence; `complete` says whether it has exactly the frames of the horizon."""
    return frames.groupBy("sequence_id").agg(
        F.sum("score").alias("total"), F.count("*").alias("n_frames"), (F.count("*") == horizon).alias("complete")
    )


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their average rank. Ties are counted first, so what is ordered as a whole
    is one row per distinct value."""
    ties = df.groupBy(value).agg(F.count("*").alias("n"))
    ranked = cumulative(ties, value, {"below": F.col("n")}, current=False, like=df)
    return ranked.select(value, "n", (F.col("below") + (F.col("n") + 1) / 2).alias("avg_rank"))
