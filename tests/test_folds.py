"""Folds over whole sequences and over pieces of them, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds

SHAPE = "sequence_id string, timestamp double, sample_id string, score double, veto boolean, confirm_ok boolean, rescan_ok boolean"


def rows(seed, sizes, nulls=True):
    rng = random.Random(seed)
    out = []
    for s, n in enumerate(sizes):
        for t in range(n):
            x = None if nulls and rng.random() < 0.05 else rng.gauss(0, 1.2)
            flag = lambda p: rng.random() < p
            out.append((f"s{s}", float(t // 2), f"{t:07d}", x, flag(0.1), flag(0.5), flag(0.5)))  # two frames at each time
    return out


def frames(spark, data):
    shuffled = data[:]
    random.Random(0).shuffle(shuffled)
    return spark.createDataFrame(shuffled, SHAPE).repartition(3)


def by_sequence(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def loop_ewma(seq, alpha, k):
    e, c = None, 0.0
    for r in seq:
        x = r[3]
        e = None if x is None else alpha * x + (1 - alpha) * (x if e is None else e)
        c = 0.0 if x is None else max(0.0, c + x - k)
        yield e, c


def loop_hysteresis(seq, high, low, min_hold):
    held = 0
    for r in seq:
        x = r[3]
        if held and x is not None and x <= low and held + 1 >= max(min_hold, 1):
            held = 0
        elif held:
            held += 1
        else:
            held = int(x is not None and x >= high)
        yield held


def loop_n_of_m(seq, n, m, threshold, cooldown):
    recent, cool = [], 0
    for r in seq:
        over = r[3] is not None and r[3] >= threshold
        recent = (recent + [over])[-m:]
        if cool:
            cool -= 1
            yield "HOLD"
        elif sum(recent) >= n:
            cool = cooldown
            yield "CONFIRM"
        else:
            yield "RESCAN" if over else "HOLD"


def loop_policy(seq, confirm_steps, rescan_steps, cooldown):
    confirms = rescans = cool = 0
    for *_, veto, confirm_ok, rescan_ok in seq:
        cooling = cool > 0
        confirms = confirms + 1 if not veto and confirm_ok else 0
        ready = confirms >= confirm_steps
        rescans = rescans + 1 if not veto and not ready and rescan_ok else 0
        cool = cooldown if not veto and ready else max(cool - 1, 0)
        action = "HOLD" if veto else "CONFIRM" if ready or cooling else "RESCAN" if rescans and rescans >= rescan_steps else "HOLD"
        yield action, cool


def loop_two_state(seq, eta):
    odds = 0.0
    for r in seq:
        up, down = math.exp(odds) * (1 - eta) + eta, math.exp(odds) * eta + 1 - eta
        odds = math.log(up / down) + r[3]
        yield odds


@pytest.fixture(params=["whole", "pieces"])
def size(request, monkeypatch):
    """Sequences as they are, or cut into pieces of a few frames."""
    if request.param == "pieces":
        monkeypatch.setattr(folds, "PIECE", 13)
        monkeypatch.setattr(folds, "BLOCK", 4)
    return request.param


def compare(out, data, loop, columns, sequences=None):
    got = {}
    for r in out.orderBy("sequence_id", "timestamp", "sample_id").collect():
        got.setdefault(r.sequence_id, []).append(tuple(r[c] for c in columns))
    for s, seq in by_sequence(data).items():
        want = [x if isinstance(x, tuple) else (x,) for x in loop(seq)]
        assert len(got[s]) == len(want)
        for a, b in zip(got[s], want):
            for x, y in zip(a, b):
                assert x == y or (isinstance(x, float) and y is not None and x == pytest.approx(y, rel=1e-9, abs=1e-9))


SIZES = [1, 2, 90, 13, 41, 7]


def test_ewma_cusum(spark, size):
    data = rows(1, SIZES)
    compare(folds.ewma_cusum(frames(spark, data), 0.3, 0.2, 2.0, 0.5), data, lambda s: loop_ewma(s, 0.3, 0.2), ["ewma", "cusum"])


@pytest.mark.parametrize("min_hold", [0, 3, 20])
def test_hysteresis(spark, size, min_hold):
    data = rows(2, SIZES)
    compare(folds.hysteresis(frames(spark, data), 1.0, -0.8, min_hold), data, lambda s: loop_hysteresis(s, 1.0, -0.8, min_hold), ["held"])


@pytest.mark.parametrize("cooldown", [0, 2, 9])
def test_n_of_m(spark, size, cooldown):
    data = rows(3, SIZES)
    compare(folds.n_of_m(frames(spark, data), 3, 5, 0.3, cooldown), data, lambda s: loop_n_of_m(s, 3, 5, 0.3, cooldown), ["action"])


def test_policy(spark, size):
    data = rows(4, SIZES)
    for setting in ((3, 1, 5), (2, 2, 1), (1, 3, 0)):
        compare(folds.policy(frames(spark, data), *setting), data, lambda s, x=setting: loop_policy(s, *x), ["action", "cooldown_left"])


def test_two_state_filter(spark, size):
    data = rows(5, SIZES, nulls=False)
    for eta in (0.1, 0.4):
        compare(folds.two_state_filter(frames(spark, data), eta), data, lambda s, e=eta: loop_two_state(s, e), ["log_odds"])
    total = lambda s: [sum(r[3] for r in s[: i + 1]) for i in range(len(s))]
    compare(folds.two_state_filter(frames(spark, data), 0.0), data, total, ["log_odds"])


def test_one_long_sequence_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(folds, "PIECE", 10_000)
    n = 60_000
    df = spark.range(n).select(F.lit("u").alias("sequence_id"), F.col("id").cast("double").alias("timestamp"), F.lpad(F.col("id").cast("string"), 7, "0").alias("sample_id"), F.sin(F.col("id")).alias("score"))
    pieces = folds.Pieces(df, ["score"])
    sizes = [r.n for r in pieces.arrays.select(F.size("rows").alias("n")).collect()]
    assert len(sizes) == 6 and sum(sizes) == n and max(sizes) < 20_000
    data = [("u", float(i), "", math.sin(i)) for i in range(n)]
    got = folds.ewma_cusum(df, 0.1, 0.0, 9.0, 9.0).orderBy("timestamp").select("ewma", "cusum").collect()
    for a, b in zip(got, loop_ewma(data, 0.1, 0.0)):
        assert tuple(a) == pytest.approx(b, abs=1e-6)


def test_no_frames(spark, size):
    empty = spark.createDataFrame([], SHAPE)
    for out in (folds.ewma_cusum(empty, 0.1, 0.0, 1.0, 1.0), folds.policy(empty), folds.two_state_filter(empty, 0.1)):
        assert out.collect() == []
