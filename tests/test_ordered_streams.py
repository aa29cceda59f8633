"""Streams whose rows come shuffled in many batches, against the batch operators and loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_engine import _frames
from tidemark.operators import folds
from tidemark.streaming import ordered, stateful


def test_shuffled_batches_give_the_batch_result(spark):
    df = _frames(spark, n=5, length=40)
    on_time, late = ordered.split_late(ordered.run(ordered.replay(df, 9.0, 4), stateful.hysteresis(120.0, 30.0, 3), "9 seconds"))
    assert late.count() == 0
    want = {r.sample_id: (r.action, r.held) for r in folds.hysteresis(df, 120.0, 30.0, 3).collect()}
    assert {r.sample_id: (r.action, r.value) for r in on_time.collect()} == want


def test_late_rows_come_out_and_none_is_lost(spark):
    df = _frames(spark, n=5, length=40)
    on_time, late = ordered.split_late(ordered.run(ordered.replay(df, 9.0, 4), stateful.ewma_cusum(0.2, 60.0, 250.0, 90.0), "1 second"))
    rows, missed = on_time.collect(), late.collect()
    assert missed and len(rows) + len(missed) == 200
    assert {r.sample_id for r in rows} | {r.sample_id for r in missed} == {r.sample_id for r in df.collect()}
    # the rows on time give what the batch operator gives for them alone
    left = df.join(late.select("sample_id"), "sample_id", "left_anti")
    want = {r.sample_id: r.action for r in folds.ewma_cusum(left, 0.2, 60.0, 250.0, 90.0).collect()}
    assert {r.sample_id: r.action for r in rows} == want


def alarms(rows, silence):
    """(sequence, first, last, how it ended) of each event, one frame at a time."""
    out, last, first = [], {}, {}
    for s, t, i, action in sorted(rows):
        if s in last and t > last[s][0] + silence:
            out.append((s, first.pop(s), last.pop(s)[1], "silence"))
        if action == "HOLD":
            if s in last:
                out.append((s, first.pop(s), last.pop(s)[1], "hold"))
        else:
            first.setdefault(s, i)
            last[s] = (t, i)
    return Counter(out + [(s, first[s], last[s][1], "silence") for s in last])


@pytest.mark.parametrize("silence", [3.0, 1000.0])
def test_alarm_events_close_by_hold_or_clock(spark, silence):
    rng = random.Random(7)
    rows = [(f"s{k}", float(t + 1), f"{k}{t:04d}", rng.choice(["HOLD", "CONFIRM", "RESCAN", "RESCAN"])) for k in range(4) for t in rng.sample(range(90), 40)]
    df = spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, action string").withColumn("score", F.lit(1.0))
    stream = ordered.alarm_events(ordered.replay(df, 12.0, 4, silence), silence, "12 seconds")
    got = stateful.to_table(stream).filter(F.col("sequence_id") != ordered.CLOCK).collect()
    assert Counter((r.sequence_id, r.start_sample_id, r.end_sample_id, r.closed_by) for r in got) == alarms(rows, silence)


def test_sequences_share_state_and_batches_have_several_files(spark, monkeypatch):
    """State is kept and asked for by groups of sequences, and a batch is written by several tasks."""
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    monkeypatch.setattr(ordered, "ROWS", 20)
    df = _frames(spark, n=5, length=40)
    replayed = ordered.replay(df, 9.0, 3)
    on_time, late = ordered.split_late(ordered.run(replayed, stateful.hysteresis(120.0, 30.0, 3), "9 seconds"))
    assert late.count() == 0
    want = {r.sample_id: (r.action, r.held) for r in folds.hysteresis(df, 120.0, 30.0, 3).collect()}
    assert {r.sample_id: (r.action, r.value) for r in on_time.collect()} == want
    seen = stateful.to_table(replayed.select("*", F.input_file_name().alias("file"))).select("file", F.regexp_extract("file", r"batch=(\d)", 1).alias("batch"))
    assert {r.batch: r.n for r in seen.groupBy("batch").agg(F.count_distinct("file").alias("n")).collect()} == {"0": 4, "1": 4, "2": 4, "3": 1}


def test_state_of_a_group_is_a_few_packed_tables(spark, monkeypatch):
    """Rows of state are Arrow tables as bytes: values are not handed over one by one, and nulls come back as they went."""
    import pyarrow as pa

    monkeypatch.setattr(ordered, "PACK", 4)
    schema = ordered._schema(ordered.Steps.waiting_shape)
    rows = [(f"s{i % 3}", float(i), f"{i:03d}", None if i % 2 else "HOLD", None if i % 5 == 0 else i / 7) for i in range(10)]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    packed = ordered._pack(table)
    assert [type(x) for (x,) in packed] == [bytes] * 3 and list(ordered._rows(ordered._unpack(packed, schema))) == rows
    assert ordered._unpack([], schema).num_rows == 0


def test_chain_steps_on_plain_numbers():
    import numpy as np

    rng = np.random.default_rng(3)
    model = {"initial": rng.dirichlet(np.ones(4)), "transition": rng.dirichlet(np.ones(4), 4), "emission": rng.dirichlet(np.ones(4), 4)}
    step, state, p = stateful.chain(model)[0], None, None
    for x in rng.integers(0, 4, 50):
        p = (model["initial"] if p is None else p @ model["transition"]) * model["emission"][:, x]
        p = p / p.sum()
        state, _, value = step(state, float(x))
        assert state == pytest.approx(p.tolist()) and value == state[0] and all(type(v) is float for v in state)


def test_rows_are_packed_before_the_shuffle(spark, monkeypatch):
    """What is shuffled and handed to the operator is a packed table for each group, whatever its rows."""
    import pyarrow as pa

    monkeypatch.setattr(ordered, "PACK", 4)
    schema = ordered._schema(ordered.Steps.waiting_shape)
    rows = [(None if i % 4 == 3 else f"s{i % 4}", float(i), f"{i:03d}", "HOLD", float("nan") if i == 5 else float(i)) for i in range(20)] + [(ordered.CLOCK, 99.0, "", None, None)]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    table = table.add_column(0, "bucket", pa.array([i % 4 % 2 for i in range(20)] + [1], pa.int32()))
    out = [r for b in ordered._dealt(table.to_batches(max_chunksize=3)) for r in b.to_pylist()]
    assert [r["bucket"] for r in out] == [0, 0, 0, 1, 1, 1]
    back = [(r["bucket"], *x) for r in out for x in ordered._rows(ordered._unpack([(r["packed"],)], schema))]
    want = [(i % 4 % 2, *r[:4], None if i == 5 else r[4]) for i, r in enumerate(rows[:20])]
    assert sorted(back, key=lambda r: r[3]) == want


def test_stores_go_by_cores_and_rows_without_a_sequence_stay(spark, monkeypatch, tmp_path):
    from tidemark.sources import frames

    monkeypatch.setattr(frames, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    df = _frames(spark, n=3, length=20).withColumn("sequence_id", F.when(F.col("sequence_id") != "s1", F.col("sequence_id")))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 30)
        on_time, late = ordered.split_late(ordered.run(ordered.replay(df, 9.0, 2), stateful.hysteresis(120.0, 30.0, 3), "9 seconds"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert len([p for p in (tmp_path / "stream/state/state/0").iterdir() if p.name.isdigit()]) == 8
    want = {r.sample_id: (r.sequence_id, r.action) for r in folds.hysteresis(df, 120.0, 30.0, 3).collect()}
    assert late.count() == 0 and {r.sample_id: (r.sequence_id, r.action) for r in on_time.collect()} == want
    assert any(s is None for s, _ in want.values())


def _due(processor, rows):
    import pyarrow as pa

    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), processor.waiting_schema)], schema=processor.waiting_schema)


def test_alarms_released_together_give_one_frame_of_events(spark):
    """The frames of a group's sequences are handed over as columns; open events go on from, and into, the states."""
    rng, processor = random.Random(11), ordered.Alarms(3.0)
    rows = sorted((f"s{k}", float(t), f"{k}{t:03d}", rng.choice(["HOLD", "CONFIRM", "RESCAN", "RESCAN"]), 1.0) for k in range(3) for t in rng.sample(range(60), 30))
    states, got = {}, []
    for low, high in ((-1.0, 20.0), (20.0, 45.0), (45.0, 99.0)):
        out = processor.release(_due(processor, [r for r in rows if low < r[1] <= high]), states, high * 1000)
        got += [] if out is None else list(zip(out["sequence_id"], out["start_sample_id"], out["end_sample_id"], out["closed_by"]))
    assert not states and Counter(got) == alarms([r[:4] for r in rows], 3.0)


def test_steps_released_together_keep_states_apart(spark):
    step, shape = stateful.two_state(0.1)
    processor, rng = ordered.Steps((step, shape)), random.Random(5)
    rows = [(f"s{k}", float(t), f"{k}{t:02d}", None, rng.gauss(0, 1)) for k in range(3) for t in range(12)]
    states, got, want = {}, {}, {}
    for low, high in ((0, 5), (5, 12)):
        out = processor.release(_due(processor, [r for r in rows if low <= r[1] < high]), states, high * 1000.0)
        got |= dict(zip(out["sample_id"], out["value"]))
    for k in range(3):
        state = None
        for r in rows[12 * k : 12 * k + 12]:
            state, _, want[r[2]] = step(state, r[4])
        assert states[f"s{k}"] == state
    assert got == want
