"""Fail-closed checks on tables. Each is one aggregation; `require` raises on the first that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import finite


class ContractError(ValueError):
    """A table breaks a contract."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError("missing required columns: " + ", ".join(missing))
    return df


def allow_only(df: DataFrame, allowed: list[str], prohibited: list[str] = ()) -> DataFrame:
    """Projection onto an allow-list; columns beyond it, and prohibited ones, fail."""
    if bad := sorted(set(df.columns) & set(prohibited)):
        raise ContractError("prohibited columns: " + ", ".join(bad))
    if extra := sorted(set(df.columns) - set(allowed)):
        raise ContractError("unexpected columns: " + ", ".join(extra))
    return require_columns(df, list(allowed)).select(*allowed)


def repeated_keys(df: DataFrame, key: str, preview: int = 5) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").orderBy(key).limit(preview)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    if rows := repeated_keys(df, key).collect():
        raise ContractError(f"repeated {key}: " + ", ".join(str(r[0]) for r in rows))
    return df


def violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and how many values of each column are null, NaN or infinite."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(~finite(F.col(c))).alias(f"bad_{c}") for c in columns])


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    found = violations(df, columns).first().asDict()
    if bad := [c for c in columns if found[f"bad_{c}"]]:
        raise ContractError("values that are not finite: " + ", ".join(bad))
    return df


def is_probability(p: Column, tolerance: float = 1e-6) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.forall(p, lambda x: x >= 0) & (F.abs(total - 1) <= tolerance)


def is_uniform_grid(grid: Column, tolerance: float = 1e-6) -> Column:
    """Strictly rising in equal steps."""
    steps = F.zip_with(F.slice(grid, 2, F.size(grid) - 1), F.slice(grid, 1, F.size(grid) - 1), lambda a, b: a - b)
    return F.forall(steps, lambda s: (s > 0) & (F.abs(s - F.element_at(steps, 1)) <= tolerance))


def require_one_grid(df: DataFrame, column: str) -> DataFrame:
    row = df.agg(F.count_distinct(column), F.count_if(~is_uniform_grid(F.col(column)))).first()
    if row[0] > 1 or row[1]:
        raise ContractError(f"{column}: {row[0]} grids, {row[1]} not uniform")
    return df


def unify_time(df: DataFrame) -> DataFrame:
    """One timestamp column from timestamp, timestamp_sim or t; where several stand they must agree."""
    have = [c for c in ("timestamp", "timestamp_sim", "t") if c in df.columns]
    if not have:
        raise ContractError("no time column")
    if len(have) > 1:
        differ = F.lit(False)
        for c in have[1:]:
            differ = differ | (F.col(c).isNotNull() & F.col(have[0]).isNotNull() & (F.col(c) != F.col(have[0])))
        if n := df.filter(differ).count():
            raise ContractError(f"time columns disagree in {n} rows")
    time = F.coalesce(*[F.col(c).cast("double") for c in have])
    return df.withColumn("__time", time).drop(*have).withColumnRenamed("__time", "timestamp")


def common_types(df: DataFrame, ids: tuple[str, ...] = ("sequence_id", "sample_id"), alert: str = "transition_alert") -> DataFrame:
    out = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns})
    return out.withColumn(alert, F.coalesce(alert, F.lit(""))) if alert in df.columns else out


def time_breaks(frames: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose time is before that of the row before them in the stated order of `position`, then of the columns ties;
    nulls come last, as in SQL."""
    w = Window.partitionBy("sequence_id").orderBy(*map(F.asc_nulls_last, ("position", *ties)))
    return frames.withColumn("before", F.lag("timestamp").over(w)).filter("before > timestamp")


def vector_matches(x: Column, scalars: list[Column], rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    near = F.zip_with(x, F.array(*scalars), lambda a, b: F.abs(a - b) <= atol + rtol * F.abs(b))
    return (F.size(x) == len(scalars)) & F.forall(near, lambda y: y)


def score_column(columns: list[str]) -> Column:
    """Which column scores an action table."""
    for c in ("score", "p_confirmable", "risk_score"):
        if c in columns:
            return F.col(c).cast("double")
    return (F.col("action") == "CONFIRM").cast("double")


def common_finite(arms: list[str]) -> Column:
    out = F.lit(True)
    for a in arms:
        out = out & finite(F.col(a))
    return out


def valid_channels(spectrum: Column, low: float, high: float) -> Column:
    """Indices of channels that are finite and strictly inside the clip range."""
    return F.filter(F.transform(spectrum, lambda x, i: F.when(finite(x) & (x > low) & (x < high), i)), lambda i: i.isNotNull())


def evaluable(spectrum: Column, low: float, high: float, share: float = 0.75) -> Column:
    return F.size(valid_channels(spectrum, low, high)) >= share * F.size(spectrum)


def vector_lengths(df: DataFrame, column: str) -> DataFrame:
    """One row on a vector column: rows, vectors that are missing or empty, vectors with a value that is not finite, and
    the least and greatest length."""
    x = F.col(column)
    size = F.when(x.isNull(), 0).otherwise(F.size(x))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(size == 0).alias("n_empty"), F.count_if(F.exists(x, lambda v: ~finite(v.cast("double")))).alias("n_not_finite"),
        F.min(size).alias("least"), F.max(size).alias("greatest"),
    )


def require_vectors(df: DataFrame, column: str) -> DataFrame:
    """Vectors of one length, none empty, all finite: what a continuous observation has to be."""
    found = vector_lengths(require_columns(df, [column]), column).first()
    if found["n_empty"] or found["n_not_finite"] or found["least"] != found["greatest"]:
        raise ContractError(f"{column}: {found['n_empty']} empty, {found['n_not_finite']} not finite, lengths {found['least']} to {found['greatest']}")
    return df


def class_counts(df: DataFrame, label: str, positive: str, negative: str) -> DataFrame:
    """Rows of both classes, rows of neither, and whether the table can train a classifier."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == positive).alias("n_positive"), F.count_if(y == negative).alias("n_negative"), F.count_if(~F.coalesce(y.isin(positive, negative), F.lit(False))).alias("n_other"))
    return counts.withColumn("usable", (F.col("n_positive") > 0) & (F.col("n_negative") > 0) & (F.col("n_other") == 0))


def require_both_classes(df: DataFrame, label: str, positive: str, negative: str) -> DataFrame:
    if not (found := class_counts(df, label, positive, negative).first())["usable"]:
        raise ContractError(f"{label}: {found['n_positive']} {positive}, {found['n_negative']} {negative}, {found['n_other']} others")
    return df


def same(a: Column, b: Column) -> Column:
    """Equality in which nulls, and NaNs, are equal to one another."""
    return a.eqNullSafe(b)


def complete_sequences(frames: DataFrame, n: int = 10) -> DataFrame:
    """Per sequence: its frames, and whether they are exactly n at times 0 .. n - 1, each with an id of its own."""
    ids = F.count_distinct("sample_id") == F.count("*")
    times = F.array_sort(F.collect_list(F.col("timestamp").cast("double")))
    wanted = F.array(*[F.lit(float(t)) for t in range(n)])
    return frames.groupBy("sequence_id").agg(F.count("*").alias("n_frames"), ((F.count("*") == n) & ids & (times == wanted)).alias("complete"))


def require_complete_sequences(frames: DataFrame, n: int = 10) -> DataFrame:
    if bad := complete_sequences(frames, n).filter("NOT complete").orderBy("sequence_id").limit(5).collect():
        raise ContractError(f"sequences without exactly {n} frames in order: " + ", ".join(str(r["sequence_id"]) for r in bad))
    return frames


def score_faults(scores: DataFrame) -> DataFrame:
    """One row on identified scores (sequence_id, score): ids that are blank or repeated, scores that are negative or
    not finite."""
    blank = F.trim(F.coalesce("sequence_id", F.lit(""))) == ""
    return scores.agg(
        F.count("*").alias("n_rows"), F.count_if(blank).alias("n_blank"), (F.count("sequence_id") - F.count_distinct("sequence_id")).alias("n_repeated"),
        F.count_if(~finite(F.col("score")) | (F.col("score") < 0)).alias("n_bad_scores"),
    )


LEVELS = (0.01, 0.02, 0.05)


def decided(p_values: DataFrame, alpha: float) -> DataFrame:
    """Decisions p <= alpha at one of the levels agreed beforehand."""
    if alpha not in LEVELS:
        raise ContractError(f"level {alpha} is not one of {LEVELS}")
    p = F.col("p_value")
    return p_values.withColumn("rejected", F.when(finite(p) & (p >= 0) & (p <= 1), p <= alpha).otherwise(F.raise_error(F.lit("p values lie between 0 and 1")).cast("boolean")))


def with_evidence(frames: DataFrame, evidence: DataFrame, vector: str = "x", size: int = 8) -> DataFrame:
    """Vectors with the frame's evidence behind them, of the sequences in which every frame has finite evidence.
    evidence: sample_id, sequence_id, log_lr."""
    whole = evidence.groupBy("sequence_id").agg(F.bool_and(finite(F.col("log_lr"))).alias("whole")).filter("whole").select("sequence_id")
    own = evidence.join(whole, "sequence_id", "left_semi").select("sample_id", "log_lr")
    out = frames.join(own, "sample_id").withColumn("v", F.concat(vector, F.array("log_lr")))
    return out.withColumn("v", F.when(F.size(vector) == size, F.col("v")).otherwise(F.raise_error(F.lit(f"{size} indicators are needed"))))


def attach_split(actions: DataFrame, assignment: DataFrame, unit: str) -> DataFrame:
    """split of each row by an assignment (id, split), `unavailable` where there is none; labels that are missing are
    `unknown`."""
    if unit not in actions.columns:
        out = actions.withColumn("split", F.lit("unavailable"))
    else:
        known = assignment.select(F.col("id").cast("string").alias("__id"), "split")
        out = actions.join(known, F.col(unit).cast("string") == F.col("__id"), "left").drop("__id").withColumn("split", F.coalesce("split", F.lit("unavailable")))
    return out.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("unknown")) if "label" in actions.columns else F.lit("unknown"))
