"""Stream operators over rows that arrive in any order, by `transformWithStateInPandas`.

Sequences are dealt to BUCKETS groups by a hash, which have state and a timer each, and rows are packed into a few
Arrow tables as bytes, as every call for state, every row in it and every value in a row costs much. They are packed
before they are shuffled, as every row that is handed to the operator costs as much again. Rows of a group
wait in list state until the watermark has passed them; an event-time timer then releases them in the order of (timestamp, sample_id) within each sequence, so a stream in many shuffled batches gives what the batch operator gives. A row that the
watermark had passed before it came is late: it leaves at once, marked, and touches no state; none is dropped. A group
keeps one timer, at the earliest thing due. Rows of CLOCK only move the watermark.

Every partition of the state is a store that each batch opens and commits, whatever it holds, so there are as many as
the cores ask for (`stores`), not as many as a shuffle of a large table has.

The column that carries the watermark is projected away above it: Spark then keeps the watermark for timers, but doesn't
take late rows out before the operator sees them. State is kept by RocksDB, as list state needs it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.frames import scratch
from tidemark.streaming.stateful import EVENTS, OUTPUT, to_table

#: The sequence of rows that only move the clock.
CLOCK = "\x00clock"
#: Groups of sequences; a task holds the waiting rows of one at a time.
BUCKETS = 1024
#: Rows that are packed into one of state.
PACK = 10_000
#: Rows that are gathered to be packed by group.
GATHER = 1_000_000
#: Rows of a file of a replayed table, about.
ROWS = 250_000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t: float) -> int:
    return math.floor(t * 1000)


def _passed(timers) -> float:
    """The watermark in milliseconds; before the first one it reads 0, which has passed nothing."""
    return timers.getCurrentWatermarkInMs() or -math.inf


def _schema(shape: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))


def _pack(table) -> list[tuple]:
    """An Arrow table as rows of state, each of PACK rows of it at most."""
    import pyarrow as pa

    out = []
    for i in range(0, table.num_rows, PACK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(i, PACK))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpack(packed, schema):
    import pyarrow as pa

    tables = []
    for (own,) in packed:
        with pa.ipc.open_stream(own) as reader:
            tables.append(reader.read_all())
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _list(column) -> list:
    """The values of a column; by way of NumPy unless it would make numbers of nulls."""
    import pyarrow as pa

    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy().tolist()


def _rows(table) -> Iterator[tuple]:
    return zip(*map(_list, table.columns))


def _runs(keys: list) -> Iterator[tuple]:
    """(key, from, to) of each stretch of equal keys."""
    at = 0
    for key, own in groupby(keys):
        start, at = at, at + sum(1 for _ in own)
        yield key, start, at


def _over(table, passed: float) -> np.ndarray:
    """Which rows the watermark has passed."""
    return np.floor(table["timestamp"].to_numpy() * 1000) <= passed


def _first(table) -> float | None:
    import pyarrow.compute as pc

    return pc.min(table["timestamp"]).as_py()


def _dealt(batches):
    """Rows with their group as one packed table, or a few, for each group of GATHER rows; those of CLOCK are left out, as
    the watermark has seen them below."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def packs(held: list):
        table = pa.Table.from_batches(held)
        table = table.filter(pc.fill_null(pc.not_equal(table["sequence_id"], CLOCK), True))
        if table["timestamp"].null_count:
            raise ValueError("a frame without a timestamp has no place in the order")
        # a score that is no number is none
        score = pc.if_else(pc.is_nan(table["score"]), pa.scalar(None, pa.float64()), table["score"])
        table = table.set_column(table.schema.get_field_index("score"), "score", score).sort_by("bucket").combine_chunks()
        rows = table.drop_columns(["bucket"])
        out = [(key, own) for key, a, b in _runs(_list(table["bucket"])) for (own,) in _pack(rows.slice(a, b - a))]
        for i in range(0, len(out), 64):
            keys, own = zip(*out[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(own, pa.binary())], ["bucket", "packed"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHER:
            yield from packs(held)
            held, n = [], 0
    if n:
        yield from packs(held)


class _InOrder(StatefulProcessor):
    """Holds frames back and hands them on in order. Subclasses say what a released frame does (`frame`) and what else
    falls due (`due`, `expire`); the states of a group's sequences are a list that is read once and written once a
    release."""

    waiting_shape = "sequence_id string, timestamp double, sample_id string, action string, score double"
    columns: list[str]

    def __init__(self, state_shape: str) -> None:
        self.waiting_schema, self.held_schema = _schema(self.waiting_shape), _schema(f"sequence_id string, {state_shape}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = handle.getListState("waiting", "packed binary"), handle.getListState("held", "packed binary")

    def release(self, due, states: dict, passed: float) -> pd.DataFrame | None:
        """What the frames that are released together do, which are in order: their output. `states` is brought up to date."""
        out, rows = [], list(zip(*map(_list, due.columns[1:])))
        ready = {key: (a, b) for key, a, b in _runs(_list(due["sequence_id"]))}
        for key in states | ready:
            state = states.pop(key, None)
            for row in rows[slice(*ready.get(key, (0, 0)))]:
                state = self.frame(key, self.expire(key, state, row[0], out), row, out)
            state = self.expire(key, state, passed / 1000, out)
            if state is not None:
                states[key] = state
        return self._frame(out) if out else None

    def frame(self, key: str, state: tuple | None, row: tuple, out: list) -> tuple | None:
        raise NotImplementedError

    def due(self, state: tuple | None) -> float | None:
        """When the state itself falls due, in seconds."""
        return None

    def expire(self, key: str, state: tuple | None, now: float, out: list) -> tuple | None:
        return state

    def late(self, key: str, row: tuple) -> tuple:
        raise NotImplementedError

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.columns, map(list, zip(*rows)))))

    def _alarm(self, waiting_first: float | None, states) -> None:
        at = min((_ms(t) for t in (waiting_first, *map(self.due, states)) if t is not None), default=None)
        for timer in list(self.handle.listTimers()):
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        own = _unpack([(x,) for batch in rows for x in batch["packed"]], self.waiting_schema)
        late = _over(own, _passed(timerValues))
        new = own.filter(pa.array(~late))
        if new.num_rows:
            self.waiting.appendList(_pack(new))
            at, timers = _ms(_first(new)), list(self.handle.listTimers())
            if not timers or at < min(timers):
                for timer in timers:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
        if late.any():
            yield self._frame([self.late(row[0], row[1:]) for row in _rows(own.filter(pa.array(late)))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        passed = _passed(timerValues)
        waiting = _unpack(self.waiting.get(), self.waiting_schema)
        over = _over(waiting, passed)
        rest = waiting.filter(pa.array(~over))
        due = waiting.filter(pa.array(over)).sort_by([(c, "ascending") for c in ("sequence_id", "timestamp", "sample_id")])
        states = {r[0]: r[1:] for r in _rows(_unpack(self.held.get(), self.held_schema))}
        before = dict(states)
        out = self.release(due, states, passed)
        if due.num_rows:
            if rest.num_rows:
                self.waiting.put(_pack(rest))
            else:
                self.waiting.clear()
        if not states:
            self.held.clear()
        elif states != before:
            columns = zip(*((sequence, *state) for sequence, state in states.items()))
            self.held.put(_pack(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.held_schema)], schema=self.held_schema)))
        self._alarm(_first(rest), states.values())
        if out is not None:
            yield out

    def close(self) -> None:
        pass


class Steps(_InOrder):
    """An operator of `stateful` (ewma_cusum, hysteresis, ...), a step for each released frame."""

    columns = [c.split()[0] for c in OUTPUT.split(", ")] + ["late"]

    def __init__(self, operator: tuple[Callable, str]) -> None:
        self.step, shape = operator
        super().__init__(shape)

    def release(self, due, states, passed):
        step, scores, actions, values = self.step, _list(due["score"]), [], []
        for key, a, b in _runs(_list(due["sequence_id"])):
            state = states.get(key)
            for x in scores[a:b]:
                state, action, value = step(state, x)
                actions.append(action)
                values.append(value)
            states[key] = state
        if not actions:
            return None
        out = due.select(["sequence_id", "timestamp", "sample_id"]).to_pandas()
        return out.assign(action=actions, value=np.array(values, float), late=False)

    def late(self, key, row):
        return (key, row[0], row[1], None, None, True)


class Alarms(_InOrder):
    """Alarm events, ended by a HOLD or by more than `silence` seconds without a frame, whether the next frame or the
    watermark tells so."""

    columns = [c.split()[0] for c in EVENTS.split(", ")]

    def __init__(self, silence: float) -> None:
        self.silence = silence
        super().__init__("first_id string, last_id string, first_time double, last_time double, confirm_time double, best double")

    def due(self, state):
        return None if state is None else state[3] + self.silence + 0.001

    def expire(self, key, state, now, out):
        if state is None or now <= state[3] + self.silence:
            return state
        out.append((key, *state, "silence"))
        return None

    def frame(self, key, state, row, out):
        t, i, action, score = row
        if action == "HOLD":
            if state is not None:
                out.append((key, *state, "hold"))
            return None
        confirmed = t if action == "CONFIRM" else None
        if state is None:
            return (i, i, t, t, confirmed, score)
        best = max((x for x in (state[5], score) if x is not None), default=None)
        return (state[0], i, state[2], t, confirmed if state[4] is None else state[4], best)

    def late(self, key, row):
        return (key, row[1], row[1], row[0], row[0], None, row[3], "late")


def _transform(frames: DataFrame, processor: _InOrder, shape: str, lateness: str) -> DataFrame:
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    action = F.col("action") if "action" in frames.columns else F.lit(None).cast("string")
    at = F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    timed = frames.select("sequence_id", F.col("timestamp").cast("double"), "sample_id", action.alias("action"), F.col("score").cast("double"), at.alias("at")).withWatermark("at", lateness)
    group = F.pmod(F.xxhash64("sequence_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = timed.select(group, "sequence_id", "timestamp", "sample_id", "action", "score")
    packed = rows.mapInArrow(_dealt, "bucket int, packed binary")
    return packed.groupBy("bucket").transformWithStateInPandas(processor, shape, "append", "EventTime")


def stores(spark: SparkSession) -> int:
    """Partitions of the state: two for each core, or as many as a shuffle has if that is less."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, 8))


def table(stream: DataFrame) -> DataFrame:
    """What a stream of this module gives of all that is there now."""
    return to_table(stream, stores(stream.sparkSession))


def run(frames: DataFrame, operator: tuple[Callable, str], lateness: str = "0 seconds") -> DataFrame:
    """An operator of `stateful` over a stream of frames in any order up to `lateness`: its output, with `late` for the
    rows that came too late for it, which have no action."""
    return _transform(frames, Steps(operator), OUTPUT + ", late boolean", lateness)


def alarm_events(actions: DataFrame, silence: float, lateness: str = "0 seconds") -> DataFrame:
    """Alarm events of a stream of actions in any order up to `lateness`, each once it is over; frames that came too
    late are rows of their own, closed_by `late`."""
    return _transform(actions, Alarms(silence), EVENTS, lateness)


def replay(frames: DataFrame, lateness: float, batches: int, silence: float = 0.0) -> DataFrame:
    """A bounded table of frames as a stream in so many batches, in which rows are out of order by up to `lateness`
    seconds (told by a hash of their ids), and a row at the end that moves the clock past everything. A batch is as many
    files as every other, of about ROWS rows, each with a row of the clock, so that none is empty and left out."""
    spark, path = frames.sparkSession, scratch(frames.sparkSession, "replay")
    arrives = F.col("timestamp") + (F.xxhash64("sample_id") % 1000 + 1000) / 2000 * (0.99 * lateness)
    rows = frames.withColumn("__arrives", arrives)
    low, high, first, last, n = rows.agg(F.min("__arrives"), F.max("__arrives"), F.min("timestamp"), F.max("timestamp"), F.count("*")).first()
    low, high, first, last = (0.0, 0.0, 0.0, 0.0) if low is None else (low, high, first, last)
    width, files = max((high - low) / batches, 1e-9), max(-(-n // (batches * ROWS)), 1)
    rows = rows.withColumn("__batch", F.least(F.floor((F.col("__arrives") - low) / width), F.lit(batches - 1)))
    shape = [F.col("`" + c + "`") for c in frames.columns]

    def tick(at: float) -> list:
        clock = {"sequence_id": F.lit(CLOCK), "timestamp": F.lit(at), "sample_id": F.lit("")}
        return [clock.get(c, F.lit(None)).cast(frames.schema[c].dataType).alias(c) for c in frames.columns]

    fill = spark.range(files).select(*tick(first), F.col("id").cast("int").alias("__file"))
    for k in range(batches):  # one after another: a file source takes files by their time
        own = rows.filter(F.col("__batch") == k)
        if files == 1:
            own = own.select(*shape).coalesce(1)
        else:
            dealt = own.select(*shape, F.pmod(F.xxhash64("sample_id"), F.lit(files)).cast("int").alias("__file"))
            own = dealt.unionAll(fill).repartitionById(files, "__file").drop("__file")
        own.write.parquet(f"{path}/batch={k}")
    spark.range(1).select(*tick(last + lateness + silence + 1.0)).write.parquet(f"{path}/batch={batches}")
    return spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/batch=*")


def split_late(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `run` gives of all that is there now, as two tables: on time, and late."""
    out = table(stream)
    return out.filter("NOT late").drop("late"), out.filter("late").select("sequence_id", "timestamp", "sample_id")
