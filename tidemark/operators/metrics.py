"""Rank metrics, calibration, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import attach, quantile_values, quantiles
from tidemark.operators.ranges import cumulative, positions


def _by_score(df: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null where a class is missing.

    Rows are first summed up by distinct score; only those rows are ordered."""
    steps = cumulative(_by_score(df, score, positive, list(by)), score, {"neg_below": F.col("neg")}, current=False, by=list(by), like=df)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    out = steps.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: Column, by: list[str] = ()) -> DataFrame:
    """Tie-grouped: each distinct score adds its recall step times the precision there."""
    steps = cumulative(_by_score(df, score, positive, list(by)), score, {"tp": F.col("pos"), "seen": F.col("pos") + F.col("neg")}, descending=True, by=list(by), like=df)
    out = steps.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("area") / F.col("n_pos")).alias("average_precision"))


def average_precision_in_order(df: DataFrame, score: str, positive: Column, tiebreak: str) -> DataFrame:
    """Ties stand in the order of tiebreak; every positive row adds the precision at its place. The rows of
    a score are counted first, so a whole order is made over distinct scores alone."""
    groups = _by_score(df, score, positive, [])
    before = cumulative(groups, score, {"tp0": F.col("pos"), "seen0": F.col("pos") + F.col("neg")}, descending=True, current=False, like=df).select(score, "tp0", "seen0")
    own = Window.partitionBy(score).orderBy(tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__y", positive.cast("long")).withColumns({"__tp": F.sum("__y").over(own), "__n": F.row_number().over(Window.partitionBy(score).orderBy(tiebreak))}).join(before, score)
    precision = (F.col("tp0") + F.col("__tp")) / (F.col("seen0") + F.col("__n"))
    return rows.agg((F.sum(F.when(F.col("__y") == 1, precision)) / F.sum("__y")).alias("average_precision"))


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    steps = _by_score(df, score, positive, [])
    total = steps.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    run = cumulative(steps, score, {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, like=df)
    return run.join(F.broadcast(total)).select(F.col(score).alias("threshold"), (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"))


def concordance(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Concordance index over pairs of different targets, tied predictions half.

    Counting needs, for each row, how many rows of smaller target have a smaller prediction. Both are
    first turned into dense ranks; the ranks of predictions are halved level by level (as a merge sort
    does), all levels in one grouped running count, so no pair is ever formed."""
    rows = df.select(F.col(prediction).alias("p"), F.col(target).alias("t")).groupBy("p", "t").agg(F.count("*").alias("n"))
    ranks = positions(rows.select("p").distinct(), "p").withColumnRenamed("position", "r")
    rows = rows.join(ranks, "p")
    top = int(rows.agg(F.max("r")).first()[0] or 0)
    # pairs part at one level of their ranks: same prefix above it, one with bit 0 and one with bit 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(0, top.bit_length() - 1)))).alias("level")
    bits = rows.select("t", "n", "r", levels).select("t", "n", "level", F.expr("shiftright(r, level + 1)").alias("prefix"), F.expr("shiftright(r, level) & 1").alias("bit"))
    cells = bits.groupBy("level", "prefix", "t").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("high"))
    counted = cumulative(cells, "t", {"low_below": F.col("low"), "high_below": F.col("high")}, current=False, by=["level", "prefix"], like=rows)
    pairs = counted.agg(F.coalesce(F.sum(F.col("high") * F.col("low_below")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("low") * F.col("high_below")), F.lit(0)).alias("bad"))
    w = Window.partitionBy("p").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    tied = rows.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0))).agg(F.coalesce(F.sum(F.col("n") * F.col("below")), F.lit(0)).alias("tied"))
    comparable = F.col("good") + F.col("bad") + F.col("tied")
    return pairs.join(F.broadcast(tied)).select(
        F.col("good").alias("concordant"), "tied", comparable.alias("comparable"),
        F.when(comparable > 0, (F.col("good") + 0.5 * F.col("tied")) / comparable).alias("c_index"),
    )


def calibration_bins(df: DataFrame, prediction: str, target: str, bins: int = 10) -> DataFrame:
    """Means by quantile bins of the prediction; the last is closed, empty ones are left out."""
    edges = quantile_values(df, prediction, [i / bins for i in range(bins + 1)])
    p, which = F.col(prediction), None
    for i in range(bins):
        inside = (p >= edges[i]) & ((p < edges[i + 1]) if i < bins - 1 else (p <= edges[i + 1]))
        which = F.when(inside, i) if which is None else which.when(inside, i)
    return df.withColumn("bin", which).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.avg(prediction).alias("pred_mean"), F.avg(target).alias("target_mean"), F.count("*").alias("n")
    )


def five_numbers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    out = attach(out, quantiles(df, value, [0.25, 0.5, 0.75], by), by)
    return out.select(*by, "n", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max", "mean")


def action_rates(actions: DataFrame, labels: list[str], kinds: list[str]) -> DataFrame:
    """Counts and row shares over the whole grid of labels and actions, zeros included."""
    spark = actions.sparkSession
    grid = spark.createDataFrame([(a, k) for a in labels for k in kinds], "label string, action string")
    counts = actions.groupBy("label", "action").agg(F.count("*").alias("n"))
    full = grid.join(counts, ["label", "action"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("label"))
    return full.withColumn("rate", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def action_pivot(actions: DataFrame, kinds: list[str]) -> DataFrame:
    counts = actions.groupBy("label").pivot("action", kinds).count().fillna(0)
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return counts.select("label", *[F.col(k).alias(f"n_{k.lower()}") for k in kinds], *[(F.col(k) / total).alias(f"share_{k.lower()}") for k in kinds])


def upper_rank(df: DataFrame, score: str, share: int) -> DataFrame:
    """The k-th largest score, k = floor((m + 1) / share); null when that is 0.

    Scores are counted by distinct value, and the value at which the count from above reaches k is taken."""
    ties = df.groupBy(score).agg(F.count("*").alias("n"))
    run = cumulative(ties, score, {"above": F.col("n")}, descending=True, like=df)
    m = df.agg(F.count(score)).first()[0]
    k = (m + 1) // share
    return run.agg(F.lit(m).alias("m"), F.lit(k).alias("k"), F.max(F.when((F.col("above") >= k) & F.lit(k > 0), F.col(score))).alias("threshold"))


def conformal_p(calibration: DataFrame, evaluation: DataFrame, score: str, key: str) -> DataFrame:
    """(1 + calibration scores at or above this one) / (n + 1).

    Both sides are counted by distinct score and merged in one ordered pass over those."""
    both = calibration.groupBy(score).agg(F.count("*").alias("cal")).join(evaluation.select(score).distinct().withColumn("asked", F.lit(1)), score, "full_outer").fillna(0, ["cal"])
    n = calibration.count()
    run = cumulative(both, score, {"above": F.col("cal")}, descending=True, like=calibration)
    p = run.filter("asked = 1").select(score, ((1 + F.col("above")) / F.lit(float(n + 1))).alias("p_value"))
    return evaluation.select(key, score).join(p, score)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    from tidemark.operators.windows import average_ranks

    x = average_ranks(df, a).select(a, F.col("avg_rank").alias("ra"))
    y = average_ranks(df, b).select(b, F.col("avg_rank").alias("rb"))
    return df.join(x, a).join(y, b).agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def strata_rates(df: DataFrame, hit: Column, sets: list[list[str]]) -> DataFrame:
    """Counts, hits and rate by several groupings at once; columns that do not group are null."""
    names = sorted({c for s in sets for c in s})
    view = df.withColumn("__hit", hit.cast("long"))
    out = view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(
        F.count("*").alias("n"), F.sum("__hit").alias("hits"), (F.sum("__hit") / F.count("*")).alias("rate"), F.grouping_id().alias("level")
    )
    return out


def zscore_stats(df: DataFrame, vector: str, floor: float = 1e-12) -> DataFrame:
    """Mean and population deviation of every dimension; deviations under the floor count as 1."""
    parts = df.select(F.posexplode(vector).alias("dim", "x"))
    s = F.stddev_pop("x")
    return parts.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(s < floor, 1.0).otherwise(s).alias("std"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram with the last bin closed; equal ends are widened by one half."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def log_mean_decade(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Geometric mean and its decade; the decade is corrected where the logarithm rounds across a power of ten."""
    out = df.groupBy(*by).agg(F.avg(F.ln(value)).alias("m"), F.avg(F.log10(value)).alias("d"))
    near = F.round("d")
    return out.select(*by, F.exp("m").alias("geometric_mean"), F.when(F.abs(F.col("d") - near) < 1e-12, near).otherwise(F.floor("d")).cast("int").alias("decade"))


def status(value: Column, threshold: float, at_most: bool) -> Column:
    """pass, fail or, where there is no value, unevaluable: never a pass."""
    good = (value <= threshold) if at_most else (value >= threshold)
    return F.when(value.isNull() | F.isnan(value), "unevaluable").when(good, "pass").otherwise("fail")


def overall(criteria: DataFrame) -> DataFrame:
    fails, open_ = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "unevaluable")
    return criteria.agg(
        F.count_if(F.col("status") == "pass").alias("n_pass"), fails.alias("n_fail"), open_.alias("n_unevaluable"),
        F.when(fails > 0, "fail").when(open_ > 0, "partial").otherwise("pass").alias("overall_status"),
    )


def monotone_breaks(df: DataFrame, order: str, value: str, tolerance: float = 0.0, by: list[str] = ()) -> DataFrame:
    """Steps along an order where the value falls by more than the tolerance."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).filter(F.col("before") - F.col(value) > tolerance)


def largest_step(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("step", F.col(value) - F.lag(value).over(w)).groupBy(*by).agg(F.max("step").alias("largest_step"))
