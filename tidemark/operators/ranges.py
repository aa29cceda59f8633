"""Running sums over a whole order, without one task for all of it.

The key is cut into ranges of about ROWS rows at approximate quantiles. Sums of the ranges are a small table,
whose running sums are what stands before each range; within a range a window does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.frames import materialize

ROWS = 1_000_000
#: Ranges at most: the cuts are a literal in the plan.
MOST = 4096


def text_key(text: Column) -> Column:
    """A number in the order of the first seven bytes of a text: equal where these are equal."""
    head = F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def _cuts(rows: DataFrame, key: Column) -> list:
    return cuts_of(rows, key, rows.count())


def cuts_of(rows: DataFrame, key: Column, n: int) -> list:
    """Cuts of the key, the least of each range but the first, for ranges of about ROWS rows of n."""
    parts = min(-(-n // ROWS), MOST)
    if parts < 2:
        return []
    asked = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    return sorted({c for c in rows.agg(F.percentile_approx(key, asked, F.lit(10 * parts))).first()[0] or [] if c is not None})


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, as several jobs read it."""
    return materialize(df, "ranges")


def range_of(key: Column, cuts: list) -> Column:
    """How many cuts lie below the key, by halving; the same for equal keys."""
    if not cuts:
        return F.lit(0)
    held, steps = F.lit(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    ahead = lambda at, step: (at + step <= len(cuts)) & (F.try_element_at(held, at + step) < key)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))


def cumulative(rows: DataFrame, key: str, sums: dict[str, Column], descending: bool = False, current: bool = True, by: list[str] = (), number: Column | None = None, like: DataFrame | None = None) -> DataFrame:
    """rows with running sums in the order of key: for each name, the sum of its column over all rows before this one,
    and over this one too where current is true. Rows are distinct in key and by. number: what stands for the
    key in cutting ranges, if that is no number itself. like: what ranges are cut for, if rows are dear to make."""
    cuts = _cuts(rows if like is None else like, number if number is not None else F.col(key))
    order = F.desc(key) if descending else F.asc(key)
    until = Window.currentRow if current else -1
    if not cuts:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, until)
        return rows.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    place = range_of(number if number is not None else F.col(key), cuts)
    dealt = rows.withColumn("__range", -place if descending else place)
    totals = dealt.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    w = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, until)
    own = dealt.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    out = own.join(totals, [*by, "__range"])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def positions(rows: DataFrame, key: str, number: Column | None = None) -> DataFrame:
    """rows, distinct in key, with `position` from 0 on in the order of key."""
    return cumulative(rows, key, {"position": F.lit(1).cast("long")}, current=False, number=number)
