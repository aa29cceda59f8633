"""Streaming twins of the sequence operators: state per sequence, fed in order.

Input must be in order within a sequence up to the watermark: rows of a micro-batch are sorted, and a row
older than the last one seen is dropped. The steps are the folds' steps on plain numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "sequence_id string, timestamp double, sample_id string, action string, value double"


def ewma_cusum(alpha: float, k: float, h: float, threshold: float):
    """State: (ewma, cusum). value: ewma."""

    def step(state, x):
        ewma, cusum = state if state else (x, 0.0)
        ewma, cusum = alpha * x + (1 - alpha) * ewma, max(0.0, cusum + x - k)
        action = "CONFIRM" if ewma >= threshold or cusum >= h else "RESCAN" if ewma >= threshold * 0.8 else "HOLD"
        return (ewma, cusum), action, ewma

    return step, "ewma double, cusum double"


def hysteresis(high: float, low: float, min_hold: int):
    """State: frames in the active state. value: that."""

    def step(state, x):
        held = state[0] if state else 0
        if held:
            held = 0 if x <= low and held + 1 >= max(min_hold, 1) else held + 1
        elif x >= high:
            held = 1
        return (held,), "CONFIRM" if held else "RESCAN" if x >= low else "HOLD", float(held)

    return step, "held int"


def n_of_m(n: int, m: int, threshold: float, cooldown: int):
    """State: bits of the last m scores, how many there are, cooldown left. value: how many reach the threshold."""

    def step(state, x):
        bits, cool = state if state else (0, 0)
        over = int(x >= threshold)
        bits = (bits << 1 | over) & ((1 << m) - 1)
        count = bits.bit_count()
        if cool:
            return (bits, cool - 1), "HOLD", float(count)
        if count >= n:
            return (bits, cooldown), "CONFIRM", float(count)
        return (bits, 0), "RESCAN" if over else "HOLD", float(count)

    return step, "bits long, cool int"


def policy(confirm_at: float, rescan_at: float, veto_at: float, confirm_steps: int = 3, rescan_steps: int = 1, cooldown: int = 5):
    """State: confirm streak, rescan streak, cooldown. Scores of veto_at or more are vetoed."""

    def step(state, x):
        confirms, rescans, cool = state if state else (0, 0, 0)
        if x >= veto_at:
            return (0, 0, max(cool - 1, 0)), "HOLD", x
        confirms = confirms + 1 if x >= confirm_at else 0
        if confirms >= confirm_steps:
            return (confirms, 0, cooldown), "CONFIRM", x
        rescans = rescans + 1 if x >= rescan_at else 0
        action = "CONFIRM" if cool else "RESCAN" if rescans and rescans >= rescan_steps else "HOLD"
        return (confirms, rescans, max(cool - 1, 0)), action, x

    return step, "confirms int, rescans int, cool int"


def two_state(eta: float):
    """State: log odds. value: posterior. Scores are log likelihood ratios."""
    import math

    def step(state, x):
        odds = 0.0
        if state:
            odds = math.log(eta + (1 - eta) * math.exp(state[0])) - math.log((1 - eta) + eta * math.exp(state[0])) if eta else state[0]
        odds += x
        p = 1 / (1 + math.exp(-odds))
        return (odds,), "CONFIRM" if p > 0.9 else "HOLD", p

    return step, "odds double"


def chain(model: dict):
    """Filter of a fitted chain (`operators.hmm`) over discrete observations, which stand in score. State: the posterior.
    value: that of the first state."""
    from operator import mul

    import numpy as np

    from tidemark.operators.hmm import EPS

    n = len(model["initial"])
    start, move, seen = (np.clip(np.asarray(model[k], float), EPS, None) for k in ("initial", "transition", "emission"))
    # plain numbers: an array of so few costs more than what is done with it
    start, into, seen = start.tolist(), move.T.tolist(), seen.T.tolist()

    def step(state, x):
        ahead = [sum(map(mul, state, own)) for own in into] if state else start
        p = list(map(mul, ahead, seen[int(x)]))
        total = sum(p)
        p = tuple([v / total for v in p])
        return p, "CONFIRM" if p[0] >= 0.85 else "HOLD", p[0]

    return step, ", ".join(f"p{k} double" for k in range(n))


EVENTS = "sequence_id string, start_sample_id string, end_sample_id string, start_timestamp double, end_timestamp double, confirm_timestamp double, max_score double, closed_by string"
_OPEN = "open boolean, first_id string, last_id string, first_time double, last_time double, confirm_time double, best double"


def alarm_events(actions: DataFrame, silence: float, lateness: str = "0 seconds") -> DataFrame:
    """Alarm events of a stream of actions (sequence_id, timestamp in seconds, sample_id, action, score), each once it
    is over: by the HOLD behind it, or by the clock, when the watermark is `silence` seconds past its last frame.
    At most one event of a sequence is open. Rows must be in order within a sequence, as for `run`."""
    from pyspark.sql import functions as F

    def row(key, s, how: str):
        return (key[0], s[1], s[2], s[3], s[4], s[5], s[6], how)

    def group(key, batches, state: GroupState):
        import pandas as pd

        out, held = [], state.get if state.exists else None
        if state.hasTimedOut:
            if held[0]:
                out.append(row(key, held, "silence"))
            state.remove()
        else:
            for t, i, action, score in pd.concat(list(batches)).sort_values(["timestamp", "sample_id"], kind="stable")[["timestamp", "sample_id", "action", "score"]].itertuples(index=False):
                if action == "HOLD":
                    if held and held[0]:
                        out.append(row(key, held, "hold"))
                    held = None
                    continue
                confirmed = float(t) if action == "CONFIRM" else None
                if held and held[0]:
                    best = max(held[6], float(score))
                    held = (True, held[1], i, held[3], float(t), held[5] if held[5] is not None else confirmed, best)
                else:
                    held = (True, i, i, float(t), float(t), confirmed, float(score))
            if held:
                state.update(held)
                state.setTimeoutTimestamp(max(int((held[4] + silence) * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    timed = actions.select("sequence_id", "timestamp", "sample_id", "action", "score", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("at")).withWatermark("at", lateness)
    return timed.groupBy("sequence_id").applyInPandasWithState(group, EVENTS, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, stores: int | None = None) -> DataFrame:
    """What a stream gives of all that is there now, by way of files in the shared folder. Its state has so many
    partitions if they are given, else as many as a shuffle."""
    from tidemark.sources.frames import scratch

    spark = stream.sparkSession
    path = scratch(spark, "stream")
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", stores or width)  # a stream keeps what holds when it starts
        query = writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run(frames: DataFrame, operator: tuple[Callable, str]) -> DataFrame:
    """Apply an operator to a stream (or batch) of frames: sequence_id, timestamp, sample_id, score."""
    step, kinds = operator
    names = [k.split()[0] for k in kinds.split(", ")]

    def group(key, batches, state: GroupState):
        import pandas as pd

        now, last = (None, ("", -float("inf"))) if not state.exists else _opened(state.get, len(names))
        rows = pd.concat(list(batches)).sort_values(["timestamp", "sample_id"], kind="stable")
        out = []
        for t, i, x in zip(rows["timestamp"], rows["sample_id"], rows["score"]):
            if (t, i) <= (last[1], last[0]):
                continue
            now, action, value = step(now, float(x))
            last = (i, float(t))
            out.append((key[0], float(t), i, action, float(value)))
        if now is not None:
            state.update((*now, last[0], last[1]))
        yield pd.DataFrame(out, columns=["sequence_id", "timestamp", "sample_id", "action", "value"])

    return frames.select("sequence_id", "timestamp", "sample_id", "score").groupBy("sequence_id").applyInPandasWithState(
        group, OUTPUT, f"{kinds}, last_id string, last_time double", "append", GroupStateTimeout.NoTimeout
    )


def _opened(kept: tuple, n: int):
    return tuple(kept[:n]), (kept[n], kept[n + 1])
