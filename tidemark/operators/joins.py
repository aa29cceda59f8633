"""Joins that are asserted to be one to one, lookups, and comparisons of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import ContractError


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone, with the side."""
    a = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    return a.union(right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right_only")))


def join_report(left: DataFrame, right: DataFrame, key: str, shared: list[str] = ()) -> DataFrame:
    """One row: keys on both sides, on one alone, repeated, and rows whose shared columns differ."""
    a = left.groupBy(key).agg(F.count("*").alias("n_l"), *[F.first(c).alias(f"l_{c}") for c in shared])
    b = right.groupBy(key).agg(F.count("*").alias("n_r"), *[F.first(c).alias(f"r_{c}") for c in shared])
    j = a.join(b, key, "full_outer")
    both = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    differ = F.lit(False)
    for c in shared:
        differ = differ | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return j.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("n_r").isNull()).alias("n_left_only"),
        F.count_if(F.col("n_l").isNull()).alias("n_right_only"), F.count_if((F.col("n_l") > 1) | (F.col("n_r") > 1)).alias("n_repeated"),
        F.count_if(both & differ).alias("n_differ"),
    )


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, shared: list[str] = ()) -> DataFrame:
    """left with the columns of right, after the report says that rows match one to one."""
    r = join_report(left, right, key, list(shared)).first()
    if r["n_left_only"] or r["n_right_only"] or r["n_repeated"] or r["n_differ"]:
        raise ContractError(f"not one to one on {key}: {r.asDict()}")
    return left.join(right.drop(*[c for c in shared if c != key]), key)


def join_consistent(left: DataFrame, right: DataFrame, keys: list[str], same: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Inner join; columns of both sides must agree within a tolerance, others of right get a suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    b = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    out = left.join(b, keys)
    bad = F.lit(False)
    for c in same:
        bad = bad | (F.abs(F.col(c) - F.col(f"{c}_right")) > tolerance)
    if n := out.filter(bad).count():
        raise ContractError(f"{n} rows disagree on " + ", ".join(same))
    return out.drop(*[f"{c}_right" for c in same])


def backfill(left: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    out = left.join(lookup.select(key, column), key, "left")
    if n := out.filter(F.col(column).isNull()).count():
        raise ContractError(f"{n} rows have no {column}")
    return out


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def half_open_bin(x: Column, edges: list[float]) -> Column:
    """Index of [edge, next edge), the last one closed; null outside."""
    out = F.when(x == edges[-1], len(edges) - 2)
    for i in range(len(edges) - 1):
        out = out.when((x >= edges[i]) & (x < edges[i + 1]), i)
    return out.cast("int")


def right_closed_stratum(x: Column, edges: list[float], include_zero: bool = False) -> Column:
    """Index of (edge, next edge]; values a rounding step above the last edge belong to it."""
    import math

    last = math.nextafter(edges[-1], math.inf)
    out = F.when(x == edges[0], 0) if include_zero else F.when(x == edges[0], None)
    for i in range(len(edges) - 1):
        upper = last if i == len(edges) - 2 else edges[i + 1]
        out = out.when((x > edges[i]) & (x <= upper), i)
    return out.cast("int")
