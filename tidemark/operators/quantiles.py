"""Exact quantiles by distributed selection.

A quantile needs the values at two ranks. Rows are counted by cells of the value's range, cut at approximate quantiles;
running counts over the cells, a few thousand a group, tell which cell holds each rank, and only the rows of those cells
go on, to be cut again as long as there are more than ranges.ROWS of them. The few that are left are counted by distinct
value, and the value at which the count reaches a rank is taken. So what is shuffled are counts and the rows of a few
cells, and no task or map ever holds all values of a group. Groups of ranges.ROWS rows or fewer need none of that: their rows
are sorted in one exchange and numbered.

Nulls and NaN are left out; a group with nothing else has no row. Ties count as often as they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import ranges


def _blend(n: Column, p: float, low: Column, high: Column) -> Column:
    at = (n - 1).cast("double") * float(p)
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _asked(counts: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """keys, rank (from 0) and own, the place of the probability times two, one more for the rank above."""
    spots = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1).cast("double") * float(p)).alias("at")) for i, p in enumerate(probabilities)])
    each = counts.select(*keys, F.explode(spots).alias("s")).select(*keys, "s.i", "s.at")
    ends = F.array(F.struct((2 * F.col("i")).alias("own"), F.floor("at").alias("rank")), F.struct((2 * F.col("i") + 1).alias("own"), F.ceil("at").alias("rank")))
    return each.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.own", "e.rank")


def _before(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """counts with `before`, the rows of the group that stand before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _held(counts: DataFrame, asked: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The place (cell or value) that holds each rank asked for, with the rank counted from its beginning."""
    met = _before(counts, keys, place).join(asked, keys)
    inside = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    return met.filter(inside).withColumn("rank", F.col("rank") - F.col("before"))


def _selected(rows: DataFrame, keys: list[str], asked: DataFrame, values: int) -> DataFrame:
    """keys, own and the value at each rank asked for."""
    groups = list(keys)
    while True:
        cuts = ranges.cuts_of(rows, F.col("value"), values)
        if not cuts:
            break
        cell = f"__cell{len(groups)}"
        dealt = rows.withColumn(cell, ranges.range_of(F.col("value"), cuts))
        found = _held(dealt.groupBy(*groups, cell).agg(F.count("*").alias("n")), asked, groups, cell)
        asked = ranges.kept(found.select(*groups, cell, "own", "rank"))
        groups = [*groups, cell]
        rest = ranges.kept(dealt.join(asked.select(*groups).distinct(), groups, "left_semi"))
        values, before = rest.count(), values
        rows = rest
        if values > before // 2:  # a few values hold most rows: counting them by value is what is left
            break
    ties = rows.groupBy(*groups, "value").agg(F.count("*").alias("n"))
    if values > ranges.ROWS:
        run = ranges.cumulative(ties, "value", {"before": F.col("n")}, current=False, by=groups)
        met = run.join(asked, groups)
        found = met.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    else:
        found = _held(ties, asked, groups, "value")
    return found.select(*keys, "own", "value")


def quantiles(df: DataFrame, value: str | Column, probabilities: list[float], by: list[str] = ()) -> DataFrame:
    """by, n (values counted) and q, the array of exact quantiles, interpolated linearly between ranks."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    keys = list(by) or ["__all"]
    rows = (df if by else df.withColumn("__all", F.lit(0))).select(*keys, x.alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    rows = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(k).alias(f"__v{i}") for i, k in enumerate(keys)], "value")
    rows = ranges.kept(rows)
    plain, named = [f"__k{i}" for i in range(len(keys))], [f"__v{i}" for i in range(len(keys))]
    total = rows.count()
    sizes = rows.groupBy(*plain).agg(F.count("*").alias("n")).filter(F.col("n") > ranges.ROWS)
    large = [r[:-1] for r in sizes.collect()] if total > ranges.ROWS else []  # total / ROWS of them at most
    if large and not by:
        out = _by_cells(rows, plain, named, probabilities, total)
    elif large:
        held = F.broadcast(df.sparkSession.createDataFrame(large, ", ".join(f"{k} string" for k in plain)))
        few, rest = rows.join(held, plain, "left_semi"), rows.join(held, plain, "left_anti")
        out = _by_cells(few, plain, named, probabilities, total).unionAll(_by_order(rest, plain, named, probabilities))
    else:
        out = _by_order(rows, plain, named, probabilities)
    out = out.select(*[F.col(v).alias(k) for v, k in zip(named, keys)], "n", "q")
    return out if by else out.drop("__all")


def _by_order(rows: DataFrame, plain: list[str], named: list[str], probabilities: list[float]) -> DataFrame:
    """Quantiles of groups that a task can sort: the rows at each rank are told by their number."""
    own = Window.partitionBy(*plain)
    rows = rows.withColumns({"r": F.row_number().over(own.orderBy("value")), "n": F.count("*").over(own)})
    ends = {}
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1).cast("double") * float(p)
        ends |= {f"low{i}": F.max(F.when(F.col("r") == F.floor(at) + 1, F.col("value"))), f"high{i}": F.max(F.when(F.col("r") == F.ceil(at) + 1, F.col("value")))}
    found = rows.groupBy(*plain).agg(*[F.first(v).alias(v) for v in named], F.first("n").alias("n"), *[c.alias(k) for k, c in ends.items()])
    return found.select(*named, "n", F.array(*[_blend(F.col("n"), p, F.col(f"low{i}"), F.col(f"high{i}")) for i, p in enumerate(probabilities)]).alias("q"))


def _by_cells(rows: DataFrame, plain: list[str], named: list[str], probabilities: list[float], total: int) -> DataFrame:
    """Quantiles of groups of any size, by selection."""
    counts = rows.groupBy(*plain).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in named])
    found = _selected(rows.select(*plain, "value"), plain, _asked(counts, plain, list(probabilities)), total)
    ends = found.groupBy(*plain).agg(F.map_from_entries(F.collect_list(F.struct("own", "value"))).alias("ends"))
    each = [_blend(F.col("n"), p, F.col("ends")[F.lit(2 * i)], F.col("ends")[F.lit(2 * i + 1)]) for i, p in enumerate(probabilities)]
    return counts.join(ends, plain).select(*named, "n", F.array(*each).alias("q"))


def attach(groups: DataFrame, q: DataFrame, by: list[str], name: str = "q") -> DataFrame:
    """groups, one row for each value of by, with the quantiles as `name`; null where a group has no value."""
    q = q.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("q").alias(name))
    on = F.lit(True)
    for k in by:
        on = on & groups[k].eqNullSafe(q[f"__{k}"])
    return groups.join(q if by else F.broadcast(q), on, "left").drop(*[f"__{k}" for k in by])


def quantile_values(df: DataFrame, value: str | Column, probabilities: list[float]) -> list[float] | None:
    """The quantiles of a whole column as numbers; None where there is no value."""
    row = quantiles(df, value, probabilities).first()
    return None if row is None else list(row.q)
