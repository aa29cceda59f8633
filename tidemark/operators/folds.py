"""Sequence operators that carry state: a step for each frame, from the state before it.

The frames of a sequence meet in an array and are stepped through in the JVM. A sequence of over PIECE frames is cut
into pieces by ranges of the order, so that a hot sequence is spread over tasks. What a piece does to the state at its
start is itself a small value: an affine map for a moving average, a max-plus map for a cumulative sum, a matrix for a
chain, a table or a counter for a rule with few states. Those values compose, so the state at the start of each piece
follows from one value a piece, and every piece is then stepped through on its own.

A null score keeps a hysteresis as it is, is no hit for N of M, sets a CUSUM to 0 and leaves a moving average to start
again at the next score; the log odds of a chain stay null behind it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import switch_step
from tidemark.sources.frames import materialize

#: Frames of a sequence that one task steps through at most, about.
PIECE = 100_000
BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """start: the first state, a struct. step(state, frame): the next. Over pieces: leaf(frame) is what one frame does
    to a state, compose(a, b) what a and then b do, apply(a, state) the state after it."""

    start: Column
    step: Callable[[Column, Column], Column]
    leaf: Callable[[Column], Column]
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each item of an array.

    An accumulator is copied whole at each step, so the first pass keeps the state at the start of each block alone, and
    the second lists the states of one block at a time."""
    last = lambda a: F.element_at(a, -1)
    top = F.size(items) - 1
    # items are met by their number, as a slice would copy all of them
    places = lambda at: F.sequence(at, F.least(at + BLOCK - 1, top))
    end = lambda state, at: F.aggregate(places(at), state, lambda s, i: step(s, F.get(items, i)))
    listed = lambda state, at: F.aggregate(places(at), F.array(state), lambda acc, i: F.concat(acc, F.array(step(last(acc), F.get(items, i)))))

    def passes(blocks: Column) -> Column:
        starts = F.aggregate(F.slice(blocks, 1, F.size(blocks) - 1), F.array(start), lambda acc, at: F.concat(acc, F.array(end(last(acc), at))))
        return F.flatten(_let(starts, lambda held: F.transform(blocks, lambda at, k: F.slice(listed(F.get(held, k), at), 2, BLOCK))))

    return _let(F.sequence(F.lit(0), F.greatest(top, F.lit(0)), F.lit(BLOCK)), passes)


class Pieces:
    """Frames as one array for each sequence, or for each piece of it; `scan` adds a state to every frame."""

    def __init__(self, frames: DataFrame, carry: list[str]) -> None:
        self.fields = ["timestamp", "sample_id", *[c for c in carry if c not in ("timestamp", "sample_id", "sequence_id")]]
        frames = frames.select("sequence_id", *self.fields)
        longest, total = frames.groupBy("sequence_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        self.cut = (longest or 0) > PIECE
        if self.cut:
            frames = frames.repartitionByRange(-(-total // PIECE), "sequence_id", "timestamp", "sample_id").withColumn("piece", F.spark_partition_id())
        else:
            frames = frames.withColumn("piece", F.lit(0))
        self.arrays = frames.groupBy("sequence_id", "piece").agg(F.sort_array(F.collect_list(F.struct(*self.fields))).alias("rows"))
        if self.cut:
            self.arrays = materialize(self.arrays, "pieces")

    def _starts(self, rule: Rule) -> DataFrame:
        """The state at the start of every piece of a sequence that has several."""
        def effect(rows: Column) -> Column:
            return F.aggregate(F.slice(rows, 2, F.size(rows)), rule.leaf(F.element_at(rows, 1)), lambda a, row: rule.compose(a, rule.leaf(row)))

        each = self.arrays.select("sequence_id", "piece", _let(F.col("rows"), effect).alias("effect"))
        whole = each.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("piece", "effect"))).alias("pieces")).filter(F.size("pieces") > 1)
        before = running(F.col("pieces"), rule.start, lambda state, p: rule.apply(p["effect"], state))
        zipped = F.explode(F.arrays_zip(F.slice("pieces.piece", 2, F.size("pieces")).alias("piece"), before.alias("start")))
        return whole.select("sequence_id", zipped.alias("z")).select("sequence_id", "z.*").filter("piece IS NOT NULL")

    def scan(self, name: str, rule: Rule) -> "Pieces":
        """The same with `name`, the state after the frame, as one more field of every frame."""
        out = object.__new__(Pieces)
        out.cut, out.fields, arrays, start = self.cut, [*self.fields, name], self.arrays, rule.start
        if self.cut:
            arrays = arrays.join(self._starts(rule), ["sequence_id", "piece"], "left")
            start = F.coalesce("start", rule.start)

        def stepped(rows: Column) -> Column:
            return F.zip_with(rows, running(rows, start, rule.step), lambda row, state: F.struct(*[row[f].alias(f) for f in self.fields], state.alias(name)))

        out.arrays = arrays.select("sequence_id", "piece", _let(F.col("rows"), stepped).alias("rows"))
        return out

    def frames(self) -> DataFrame:
        return self.arrays.select("sequence_id", F.explode("rows").alias("row")).select("sequence_id", *[F.col(f"row.{f}").alias(f) for f in self.fields])


def ewma_cusum(frames: DataFrame, alpha: float, k: float, h: float, threshold: float) -> DataFrame:
    """EWMA that starts at the first score, CUSUM of score - k, and the action they call for."""

    def step(s: Column, row: Column) -> Column:
        x = row["score"]
        return F.struct(
            (alpha * x + (1 - alpha) * F.coalesce(s["ewma"], x)).alias("ewma"),
            F.greatest(F.lit(0.0), s["cusum"] + x - k).alias("cusum"),
        )

    # s -> a s + b where a score stands before, from `first` on else; anew: a null score cut off what was before
    def affine(anew, a, b, first):
        return F.struct(anew.alias("anew"), a.alias("a"), b.alias("b"), first.alias("first"))

    def leaf(row: Column) -> Column:
        x = row["score"].cast("double")
        return F.struct(
            affine(x.isNull(), F.when(x.isNull(), 1.0).otherwise(1 - alpha), F.coalesce(alpha * x, F.lit(0.0)), x).alias("mean"),
            F.lit(0.0).alias("floor"), F.coalesce(x - k, F.lit(-math.inf)).alias("add"),
        )

    def compose(p: Column, q: Column) -> Column:
        l, r = p["mean"], q["mean"]
        whole = affine(l["anew"], l["a"] * r["a"], r["a"] * l["b"] + r["b"], l["first"])
        behind = affine(F.lit(True), r["a"], r["b"], r["first"])
        mean = F.when(r["anew"] | l["first"].isNull(), behind).otherwise(whole)
        return F.struct(mean.alias("mean"), F.greatest(q["floor"], p["floor"] + q["add"]).alias("floor"), (p["add"] + q["add"]).alias("add"))

    def apply(p: Column, s: Column) -> Column:
        m = p["mean"]
        since = F.when(m["anew"], m["first"]).otherwise(F.coalesce(s["ewma"], m["first"]))
        return F.struct((m["a"] * since + m["b"]).alias("ewma"), F.greatest(p["floor"], s["cusum"] + p["add"]).alias("cusum"))

    start = F.struct(F.lit(None).cast("double").alias("ewma"), F.lit(0.0).alias("cusum"))
    out = Pieces(frames, ["score"]).scan("s", Rule(start, step, leaf, compose, apply)).frames()
    out = out.select("sequence_id", "timestamp", "sample_id", "score", "s.ewma", "s.cusum")
    confirm = (F.col("ewma") >= threshold) | (F.col("cusum") >= h)
    return out.withColumn("action", F.when(confirm, "CONFIRM").when(F.col("ewma") >= threshold * 0.8, "RESCAN").otherwise("HOLD"))


def hysteresis(frames: DataFrame, high: float, low: float, min_hold: int) -> DataFrame:
    """Active from a score of high on, until one of low or less after at least min_hold frames. held: frames
    in the active state, 0 when it is off."""
    full = max(min_hold, 1)  # how long it was held matters no further

    def step(s: Column, row: Column) -> Column:
        on, x = s["held"] > 0, row["score"]
        ends = on & (x <= low) & (s["held"] + 1 >= full)
        return F.struct(F.when(ends, 0).when(on, s["held"] + 1).when(x >= high, 1).otherwise(0).alias("held"))

    # for each number of frames held before, up to full: frames held after, counted anew or on top of those before
    def held(n, on_top):
        return F.struct(n.cast("int").alias("n"), on_top.alias("on_top"))

    def leaf(row: Column) -> Column:
        up, down = F.coalesce(row["score"] >= high, F.lit(False)), F.coalesce(row["score"] <= low, F.lit(False))
        one = held(F.lit(1), F.lit(True))
        return F.array(held(up.cast("int"), F.lit(False)), *[F.when(down, held(F.lit(0), F.lit(False))).otherwise(one) if j + 1 >= full else one for j in range(1, full + 1)])

    def after(p: Column, n: Column) -> Column:
        return F.get(p, F.least(n, F.lit(full)))

    def compose(p: Column, q: Column) -> Column:
        def both(a: Column, j: Column) -> Column:
            b = after(q, a["n"] + F.when(a["on_top"], j).otherwise(0))
            return held(b["n"] + F.when(b["on_top"], a["n"]).otherwise(0), a["on_top"] & b["on_top"])

        return F.transform(p, both)

    def apply(p: Column, s: Column) -> Column:
        a = after(p, s["held"])
        return F.struct((a["n"] + F.when(a["on_top"], s["held"]).otherwise(0)).alias("held"))

    out = Pieces(frames, ["score"]).scan("s", Rule(F.struct(F.lit(0).alias("held")), step, leaf, compose, apply)).frames()
    out = out.select("sequence_id", "timestamp", "sample_id", "score", F.col("s.held").alias("held"))
    return out.withColumn("action", F.when(F.col("held") > 0, "CONFIRM").when(F.col("score") >= low, "RESCAN").otherwise("HOLD"))


def _last_flags(flag: Callable[[Column], Column], m: int) -> Rule:
    """recent: the last m flags as 0 and 1."""
    cut = lambda a: F.when(F.size(a) > m, F.slice(a, F.size(a) - m + 1, m)).otherwise(a)
    one = lambda row: F.array(F.coalesce(flag(row), F.lit(False)).cast("int"))
    step = lambda s, row: F.struct(cut(F.concat(s["recent"], one(row))).alias("recent"))
    return Rule(F.struct(F.array().cast("array<int>").alias("recent")), step, one, lambda p, q: cut(F.concat(p, q)), lambda p, s: F.struct(cut(F.concat(s["recent"], p)).alias("recent")))


def n_of_m(frames: DataFrame, n: int, m: int, threshold: float, cooldown: int) -> DataFrame:
    """N of M with a cooldown of HOLDs behind each CONFIRM; the window goes on filling meanwhile."""
    over = lambda row: row["score"] >= threshold
    fires = lambda row: F.aggregate(row["w"]["recent"], F.lit(0), lambda a, x: a + x) >= n

    def step(s: Column, row: Column) -> Column:
        waits = s["cool"] > 0
        return F.struct(
            F.when(waits, s["cool"] - 1).when(fires(row), cooldown).otherwise(0).alias("cool"),
            F.when(waits, "HOLD").when(fires(row), "CONFIRM").when(over(row), "RESCAN").otherwise("HOLD").alias("action"),
        )

    # frames to wait after it, for each number before it
    def leaf(row: Column) -> Column:
        return F.array(F.when(fires(row), cooldown).otherwise(0), *[F.lit(j - 1) for j in range(1, cooldown + 1)])

    rule = Rule(
        F.struct(F.lit(0).alias("cool"), F.lit("HOLD").alias("action")), step, leaf,
        lambda p, q: F.transform(p, lambda j: F.get(q, j)), lambda p, s: F.struct(F.get(p, s["cool"]).alias("cool"), F.lit("HOLD").alias("action")),
    )
    out = Pieces(frames, ["score"]).scan("w", _last_flags(over, m)).scan("s", rule).frames()
    return out.select("sequence_id", "timestamp", "sample_id", "score", F.col("s.action").alias("action"))


def _streak(hit: Callable[[Column], Column]) -> Rule:
    """n: how many frames in a row were hits, up to this one."""
    sure = lambda row: F.coalesce(hit(row), F.lit(False))
    return Rule(
        F.struct(F.lit(0).alias("n")), lambda s, row: F.struct(F.when(sure(row), s["n"] + 1).otherwise(0).alias("n")),
        lambda row: F.struct(sure(row).alias("all"), sure(row).cast("int").alias("n")),
        lambda p, q: F.struct((p["all"] & q["all"]).alias("all"), (q["n"] + F.when(q["all"], p["n"]).otherwise(0)).alias("n")),
        lambda p, s: F.struct((p["n"] + F.when(p["all"], s["n"]).otherwise(0)).alias("n")),
    )


def policy(frames: DataFrame, confirm_steps: int = 3, rescan_steps: int = 1, cooldown: int = 5) -> DataFrame:
    """The alarm policy over frames with booleans veto, confirm_ok, rescan_ok: veto, then confirm by streak,
    then cooldown, then rescan by streak, else hold. A veto ends both streaks and uses up a cooldown step; a
    confirm refills the cooldown; during the cooldown the action stays CONFIRM."""
    ready = lambda row: row["c"]["n"] >= confirm_steps
    reloads = lambda row: ~row["veto"] & ready(row)

    def step(s: Column, row: Column) -> Column:
        veto, rescans = row["veto"], row["r"]["n"]
        cooling, seen = s["cool"] > 0, (rescans > 0) & (rescans >= rescan_steps)
        return F.struct(
            F.when(reloads(row), cooldown).otherwise(F.greatest(s["cool"] - 1, F.lit(0))).alias("cool"),
            F.when(veto, "HOLD").when(ready(row), "CONFIRM").when(cooling, "CONFIRM").when(seen, "RESCAN").otherwise("HOLD").alias("action"),
            F.when(veto, "VETO").when(ready(row), "CONFIRM").when(cooling, "COOLDOWN_ACTIVE").when(seen, "RESCAN").otherwise("HOLD").alias("why"),
        )

    # what the last refill left, null without one, and how many steps went by
    def leaf(row: Column) -> Column:
        return F.struct(F.when(reloads(row), cooldown).alias("left"), F.when(reloads(row), 0).otherwise(1).alias("steps"))

    def down(n: Column, steps: Column) -> Column:
        return F.greatest(n - steps, F.lit(0))

    def compose(p: Column, q: Column) -> Column:
        left = F.coalesce(q["left"], F.when(p["left"].isNotNull(), down(p["left"], q["steps"])))
        return F.struct(left.alias("left"), F.when(q["left"].isNull(), p["steps"] + q["steps"]).otherwise(q["steps"]).alias("steps"))

    def apply(p: Column, s: Column) -> Column:
        return F.struct(F.coalesce(p["left"], down(s["cool"], p["steps"])).alias("cool"), F.lit("HOLD").alias("action"), F.lit("").alias("why"))

    start = F.struct(F.lit(0).alias("cool"), F.lit("HOLD").alias("action"), F.lit("").alias("why"))
    pieces = Pieces(frames, ["veto", "confirm_ok", "rescan_ok"]).scan("c", _streak(lambda row: ~row["veto"] & row["confirm_ok"]))
    pieces = pieces.scan("r", _streak(lambda row: ~row["veto"] & ~ready(row) & row["rescan_ok"]))
    out = pieces.scan("s", Rule(start, step, leaf, compose, apply)).frames()
    return out.select("sequence_id", "timestamp", "sample_id", F.col("s.action").alias("action"), F.col("s.why").alias("why"), F.col("s.cool").alias("cooldown_left"))


def _log_add(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == -math.inf, top).otherwise(top + F.log(F.exp(a - top) + F.exp(b - top)))


def two_state_filter(frames: DataFrame, eta: float) -> DataFrame:
    """Log odds of the active state of a symmetric two-state chain, from log likelihood ratios in score, and
    its posterior. Odds start even."""
    stay, turn = math.log(1 - eta), math.log(eta) if eta else -math.inf

    def step(s: Column, row: Column) -> Column:
        return F.struct(((switch_step(s["odds"], eta) if eta else s["odds"]) + row["score"]).alias("odds"))

    # logarithms of a two by two matrix, up to a factor: the last one's state by the first one's
    def matrix(aa, ab, ba, bb):
        return F.struct(aa.alias("aa"), ab.alias("ab"), ba.alias("ba"), bb.alias("bb"))

    def leaf(row: Column) -> Column:
        x = row["score"].cast("double")
        return matrix(x + stay, x + turn, x * 0 + turn, x * 0 + stay)

    def compose(p: Column, q: Column) -> Column:
        cell = lambda i, j: _log_add(q[f"{i}a"] + p[f"a{j}"], q[f"{i}b"] + p[f"b{j}"]) - p["bb"]
        return matrix(cell("a", "a"), cell("a", "b"), cell("b", "a"), cell("b", "b"))

    def apply(p: Column, s: Column) -> Column:
        return F.struct((_log_add(p["aa"] + s["odds"], p["ab"]) - _log_add(p["ba"] + s["odds"], p["bb"])).alias("odds"))

    out = Pieces(frames, ["score"]).scan("s", Rule(F.struct(F.lit(0.0).alias("odds")), step, leaf, compose, apply)).frames()
    return out.select("sequence_id", "timestamp", "sample_id", "score", F.col("s.odds").alias("log_odds"), (1 / (1 + F.exp(-F.col("s.odds")))).alias("posterior"))


def expected_occupancy(posterior: Column, eta: float, frames_left: Column) -> Column:
    """Expected active frames among the next ones: a geometric sum in closed form."""
    r = 1 - 2 * eta
    decayed = frames_left.cast("double") if r == 1 else r * (1 - F.pow(F.lit(r), frames_left)) / (1 - r)
    return 0.5 * frames_left + (posterior - 0.5) * decayed
