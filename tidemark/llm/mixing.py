"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, at most `most` times its own size; what is over
is shared anew by weight among the others until none is above. All documents of a source should then be
taken target / size times. The whole part is taken as it is; the fractional part is rounded by the
pivotal method: of two documents with fractional copies p and q and sizes s and t, mass moves from one
to the other along (1/s, -1/t), in a random direction that keeps both expectations, until one becomes
integral. The words taken stay the same in every step.

Documents are rounded by grades of size, the longest first. Those of a grade are paired within blocks; the
one document of a block that remains fractional goes up a reduction tree, whose nodes combine FAN
residuals each. The last residual of a grade is paired with the pool of all shorter documents of its
source, which have one fraction in common and take the mass in proportion to their sizes (`settle`); the
next grade is rounded at the fraction that leaves. Every document so keeps its expectation, and a source
misses its target by less than one document of its shortest grade, unless the shorter documents together
are too few to take up a long one's rest. The rule is the same at every size of a source.

Randomness is a hash of the documents, so runs agree whatever the partitioning. Blocks hold about BLOCK
units by hash, so a hot source is spread over many. Rows equal in all columns are one unit with a
multiplicity, whatever their number.

Defined cases: a null text or one without words has size 0 and is rounded among its like, with equal
weights. A null source is a source, last in order. Repeated rows are interchangeable: as many of them are
taken as their sum asks for. An empty table gives an empty result. Other columns pass through `apply_mix`.
A very long text counts by its words like any other. The number of sources is taken to fit the driver (it
is the number of mixture components); for each the driver has a row per grade of sizes within a factor of four, of which there are 32 at most.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_columns, hashable, materialize, shuffle_width, words

BLOCK = 4096
FAN = 256
MOST = 3.0
#: Copies of one row that are written by one task, about.
RUN = 4096
#: Rows of a table of sources, about 50 bytes each, up to which it is sent to every executor; larger ones are joined.
SENT = 100_000
_EPS = 1e-9


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Target of each source: shares of the sum of sizes by weight, none above most times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free -= over
    return out


def pivot(ids, p, s, draws):
    """Round fractions p with weights s in the given order: ({id: 0 or 1}, carried id or None, its fraction)."""
    done, held, q, t = {}, None, 0.0, 1.0
    for i, x, w, u in zip(ids, p, s, draws):
        if x <= _EPS or x >= 1 - _EPS:
            done[i] = int(x > 0.5)
            continue
        if held is None:
            held, q, t = i, x, w
            continue
        up = min((1 - x) * w, q * t)
        down = min(x * w, (1 - q) * t)
        move = up if u * (up + down) < down else -down
        x, q = x + move / w, q - move / t
        if x <= _EPS or x >= 1 - _EPS:
            done[i] = int(x > 0.5)
            if q <= _EPS or q >= 1 - _EPS:
                done[held], held = int(q > 0.5), None
        else:
            done[held] = int(q > 0.5)
            held, q, t = i, x, w
    return done, held, q


def settle(q: float, w: float, f: float, pool: float, draws) -> tuple[int, float]:
    """A fractional unit of weight w against a pool of weight pool, in which all units have the fraction f: whether
    the unit is taken, and the fraction left in the pool. Where the pool becomes integral first, chance decides."""
    if f * pool > _EPS and (1 - f) * pool > _EPS:
        up, down = min((1 - q) * w, f * pool), min(q * w, (1 - f) * pool)
        move = up if draws[0] * (up + down) < down else -down
        q, f = q + move / w, min(max(f - move / pool, 0.0), 1.0)
    if _EPS < q < 1 - _EPS:
        q = float(draws[1] < q)
    return int(q > 0.5), f


def _draw(*columns: str | Column) -> Column:
    """Uniform on [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _round(pdf, order: list[str], out: list[str]):
    """Pivot units from the heaviest to the lightest; up: 0 or 1, or -1 for the unit that remains at fraction p."""
    import numpy as np

    pdf = pdf.sort_values(["weight", *order], ascending=[False] + [True] * len(order), kind="stable", ignore_index=True)
    done, _, q = pivot(range(len(pdf)), pdf["p"].to_numpy(), pdf["weight"].to_numpy(), pdf["u"].to_numpy())
    pdf["up"] = np.array([done.get(i, -1) for i in range(len(pdf))], np.int32)
    pdf["p"] = np.where(pdf["up"] < 0, q, 0.0)
    return pdf[out]


_UNIT = ["doc_id", "h", "g", "sid", "size", "n", "base", "whole"]
_LEVEL = [*_UNIT, "block", "weight", "p", "u", "up"]
_NODE = ["sid", "node", "block", "weight", "p", "u", "up"]


def _round_block(pdf):
    return _round(pdf, ["doc_id", "h", "g"], _LEVEL)


def _round_node(pdf):
    return _round(pdf, ["block"], _NODE)


def _n_words() -> Column:
    return F.size(words(F.col("text"))).cast("long")


def _draws(seed: str, sid: int, grade: int) -> tuple[float, float]:
    """Two uniform numbers from a hash, for what is decided on the driver."""
    digest = hashlib.blake2b(f"{seed}/{sid}/{grade}".encode(), digest_size=16).digest()
    return tuple(int.from_bytes(digest[k : k + 8], "little") / 2**64 for k in (0, 8))


def _round_grade(units: DataFrame, found: list, fractions: dict[int, float], rates: dict[int, float]) -> tuple[DataFrame, list[DataFrame], list]:
    """Units of one grade: (rounded in blocks, what the tree decided, the last residual of each source)."""
    spark = units.sparkSession
    known = [(r["sid"], fractions[r["sid"]], int(rates[r["sid"]]), max(1, -(-r["units"] // BLOCK))) for r in found]
    known = _sized(spark, known, "sid int, f double, base int, blocks long")  # a row for each source
    mass = F.col("n") * F.col("f")
    dealt = units.join(known, "sid").select(
        "doc_id", "h", "g", "sid", "size", "n", "base", F.floor(mass + _EPS).alias("whole"),
        F.pmod(F.xxhash64("doc_id", "h", F.lit("block")), F.col("blocks")).alias("block"),
        F.greatest("size", F.lit(1)).cast("double").alias("weight"),
        F.greatest(mass - F.floor(mass + _EPS), F.lit(0.0)).alias("p"), _draw("doc_id", "h", "g", F.lit("pivot")).alias("u"),
    )
    shape = "doc_id long, h long, g int, sid int, size long, n long, base int, whole long, block long, weight double, p double, u double, up int"
    level = materialize(dealt.groupBy("sid", "block").applyInPandas(_round_block, shape), "pivot")
    nodes = level.filter("up < 0").select("sid", F.col("block").alias("node"), "block", "weight", "p", "u")
    blocks, decided = max(-(-r["units"] // BLOCK) for r in found), []
    while blocks > 1:
        blocks = -(-blocks // FAN)
        shape = "sid int, node long, block long, weight double, p double, u double, up int"
        step = materialize(nodes.withColumn("node", F.expr(f"node div {FAN}")).groupBy("sid", "node").applyInPandas(_round_node, shape), "residuals")
        decided.append(step.filter("up >= 0").select("sid", "block", "up"))
        nodes = step.filter("up < 0").select("sid", "node", "block", "weight", "p", "u")
    return level, decided, nodes.select("sid", "block", "weight", "p").collect()  # one row for each source at most


def _sized(spark, rows: list, shape: str) -> DataFrame:
    """A table of sources, for a join: sent out whole where it is small."""
    df = spark.createDataFrame(rows, shape)
    return F.broadcast(df) if len(rows) <= SENT else df


def _rounded(docs: DataFrame, weights, most: float) -> tuple[DataFrame, DataFrame | None]:
    """Units: doc_id, h, g, size, n (equal rows), base (copies of each), more (those that have one more), sid; and
    known: sid, source_size and target of each source. (known is None for an empty table.)"""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", _n_words().alias("size"), F.xxhash64(*hashable(docs)).alias("h"), F.hash(*hashable(docs)).alias("g"))
    rows = rows.groupBy("doc_id", "source", "size", "h", "g").agg(F.count("*").alias("n"))
    grade = F.when(F.col("size") > 0, F.expr("cast((length(bin(size)) - 1) div 2 AS int)")).otherwise(-1)
    rows = materialize(rows.withColumn("grade", grade), "sizes", "grade")
    found = rows.groupBy("source", "grade").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("units")).collect()
    names = sorted({r["source"] for r in found}, key=lambda x: (x is None, x or ""))
    number = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        sizes[number[r["source"]]] += r["size"]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    rates = {i: a / s if s else 0.0 for i, (a, s) in enumerate(zip(aims, sizes))}
    if not names:
        return rows.select("doc_id", "h", "g", "size", "n", F.lit(0).alias("base"), F.lit(0).cast("long").alias("more"), F.lit(0).alias("sid")), None
    of_source = _sized(spark, list(enumerate(names)), "sid int, name string")
    rows = rows.join(of_source, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    first = {i: r - int(r) for i, r in rates.items()}
    fractions, pools, parts = dict(first), dict(enumerate(sizes)), []
    for grade in sorted({r["grade"] for r in found}, reverse=True):
        own = [{"sid": number[r["source"]], "units": r["units"], "size": r["size"]} for r in found if r["grade"] == grade]
        if grade < 0:
            fractions = dict(first)
        level, decided, last = _round_grade(rows.filter(F.col("grade") == grade), own, fractions, rates)
        for r in own:
            pools[r["sid"]] -= r["size"]
        settled = []
        for r in last:
            up, fractions[r["sid"]] = settle(r["p"], r["weight"], fractions[r["sid"]], float(pools[r["sid"]]), _draws("mix", r["sid"], grade))
            settled.append((r["sid"], r["block"], up))
        at_root = _sized(spark, settled, "sid int, block long, up int")
        more = (F.col("whole") + F.col("up")).alias("more")
        out = ["doc_id", "h", "g", "size", "n", "base", more, "sid"]
        parts.append(level.filter("up >= 0").select(*out))
        parts += [level.filter("up < 0").drop("up").join(x, ["sid", "block"]).select(*out) for x in (*decided, at_root)]
    known = _sized(spark, [(i, sizes[i], aims[i]) for i in range(len(names))], "sid int, source_size long, target double")
    return reduce(DataFrame.union, parts), known


def _spread(df: DataFrame, count: Column) -> tuple[DataFrame, DataFrame]:
    """df with `run`, the parts of 0 .. count - 1 that are RUN long at most: (rows of one part, rows of many)."""
    last = count.cast("long") - 1
    runs = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RUN).cast("long"))).alias("lo")
    df = df.filter(last >= 0)
    few = df.filter(last < RUN).withColumn("run", F.sequence(F.lit(0).cast("long"), last))
    many = df.filter(last >= RUN).select("*", last.alias("last"), runs)
    many = many.withColumn("run", F.sequence("lo", F.least(F.col("lo") + RUN - 1, "last"))).drop("last", "lo")
    return few, many


def mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of docs, and h, g: hashes of all its columns."""
    units, known = _rounded(docs, weights, most)
    if known is None:
        return units.select("doc_id", "h", "g", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"))
    few, many = _spread(units, F.col("n"))
    each = few.union(many.repartition(shuffle_width(docs.sparkSession), "h", F.element_at("run", 1)))
    each = each.withColumn("at", F.explode("run")).join(known, "sid")
    copies = (F.col("base") + (F.col("at") < F.col("more")).cast("int")).cast("int")
    return each.select("doc_id", "h", "g", "size", "source_size", "target", copies.alias("copies"))


def apply_mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    units, _ = _rounded(docs, weights, most)
    taken = units.select("h", "g", (F.col("base") * F.col("n") + F.col("more")).alias("times"))
    few, many = _spread(taken, F.col("times"))
    own = docs.select(F.struct(*as_columns(docs)).alias("row"), F.xxhash64(*hashable(docs)).alias("h"), F.hash(*hashable(docs)).alias("g"))
    out = few.join(own.dropDuplicates(["h", "g"]), ["h", "g"]).select("row", F.explode("run")).select("row.*")
    if not many.isEmpty():
        keys = many.select("h", "g").distinct()
        often = own.join(keys, ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
        dealt = many.join(often, ["h", "g"]).repartition(shuffle_width(docs.sparkSession), "h", F.element_at("run", 1))
        out = out.union(dealt.select("row", F.explode("run")).select("row.*"))
    return out
