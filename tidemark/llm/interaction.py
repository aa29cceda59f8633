"""Filter interaction audit by inclusion-exclusion.

Every document has one flag for each filter it fails. One aggregation sums the product of the flags for each of the
2^k sets of filters, which gives the joint failure counts J(S) of each part: 32 sums for five filters, however many
documents there are. All else is a Moebius inversion of those sums, so no document is looked at again:

* removed by filter i behind the set P: the sum over S in P of (-1)^|S| J(S + i);
* kept behind P: the sum over S in P of (-1)^|S| J(S);
* failing i alone: as removed, with P all other filters;
* Shapley: the game "documents that P removes" has the Harsanyi dividends (-1)^(|S|+1) J(S), of which each member of S
  gets the |S|-th part; times k! that is a whole number, the sum of i's removals over all orders.

A copy is told by the SHA-256 of its text. The first of each text is found by a minimum per digest, merged in each task
before the exchange, and met by (digest, doc_id), a key that no group of copies makes hot.

Defined cases: a null text is empty. A null doc_id has no order: such a row is no copy, nothing is a copy of it, and it
has no label. Rows with the same text and the same least doc_id are all first. A doc_id with several labels has each
class that any of them gives. A null part is the empty string. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, words

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


def row_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at it alone."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """part, doc_id, n (equal rows) and the flags A to E of all documents."""
    own = row_failures(F.col("text"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest")
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest, *[c.alias(f) for f, c in own.items()])
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "failures")
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    unknown = rows.filter("doc_id IS NULL").withColumn("E", F.lit(False))
    fields = ["part", "doc_id", "n", *FILTERS]
    return known.select(*fields).union(unknown.select(*fields))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with booleans good and toxic, false where no label says so."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    unknown = rows.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return rows.filter("doc_id IS NOT NULL").join(said, "doc_id", "left").fillna(False, ["good", "toxic"]).union(unknown.select("doc_id", *[c for c in rows.columns if c != "doc_id"], "good", "toxic"))


def joint_failures(rows: DataFrame, flags: str, by: str, weights: dict[str, Column]) -> DataFrame:
    """For each value of `by` and each weight an array of 2^k sums: at index S (bit i for the i-th flag) the
    weight of the rows that fail all of S."""
    def product(s: int) -> str:
        return " * ".join([f"CAST({f} AS LONG)" for i, f in enumerate(flags) if s >> i & 1] or ["1L"])

    rows = rows.select(by, *flags, *[c.alias(w) for w, c in weights.items()])
    sums = {f"__{w}_{s}": F.expr(f"sum({product(s)} * {w})") for w in weights for s in range(1 << len(flags))}
    out = rows.groupBy(by).agg(*[c.alias(name) for name, c in sums.items()])
    return out.select(by, *[F.array(*[F.col(f"__{w}_{s}") for s in range(1 << len(flags))]).alias(w) for w in weights])


def _signed(joint: str, inside: str, also: str) -> Column:
    """Sum over the subsets s of the set `inside` of (-1)^|s| J(s + also)."""
    return F.expr(f"aggregate(filter(sequence(0, size({joint}) - 1), s -> (s & {inside}) = s), 0L, (t, s) -> t + (1 - 2 * (bit_count(s) % 2)) * {joint}[s | {also}])")


def interactions(joint: DataFrame, flags: str, by: str, losses: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the joint failures `total` and those of each loss."""
    k = len(flags)
    orders = F.lit(["".join(p) for p in permutations(flags)])
    bit = lambda at: f"shiftleft(1, instr('{flags}', substr(filter_order, {at}, 1)) - 1)"
    rows = joint.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.lit(list(range(1, k + 1)))))
    before = F.expr(f"aggregate(transform(slice(sequence(1, {k}), 1, step - 1), p -> {bit('p')}), 0, (t, b) -> t | b)")
    rows = rows.withColumns({"own": F.expr(bit("step")), "before": before})
    shapley = f"aggregate(filter(sequence(1, size(total) - 1), s -> (s & own) != 0), 0L, (t, s) -> t + (2 * (bit_count(s) % 2) - 1) * total[s] * ({factorial(k)}L div bit_count(s)))"
    removed, fails = _signed("total", "before", "own"), F.expr("total[own]")
    return rows.select(
        by, "filter_order", "step",
        _signed("total", "(before | own)", "0").alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        _signed("total", f"({(1 << k) - 1} - own)", "own").alias("unique_fails"),
        *[_signed(x, "before", "own").alias(f"{x}_lost") for x in losses],
        F.expr(shapley).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    rows = labelled(failures(docs, part), labels)
    n = F.col("n")
    weights = {"total": n, "good": n * F.col("good").cast("long"), "toxic": n * F.col("toxic").cast("long")}
    joint = materialize(joint_failures(rows, FILTERS, "part", weights), "joint")
    return interactions(joint, FILTERS, "part", ["good", "toxic"])
