"""Staged and sealed runs over `events`, held against SQL that has no stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import alarms, stages
from tidemark.plans.registry import query, sql
from tidemark.sources.frames import scratch

GRID = [0.25, 0.5, 1.0, 1.5, 2.0]


def _moments(rows: DataFrame) -> dict:
    mean, std = rows.agg(F.avg("score"), F.stddev_pop("score")).first()
    return {"mean": mean, "std": max(std, 1e-12)}


def _history(rows: DataFrame, state: dict) -> list[dict]:
    """Share of rows that each threshold calls right, in one pass."""
    z = (F.col("score") - state["mean"]) / state["std"]
    right = [F.avg(((z > t) == (F.col("label") == "hazard")).cast("double")) for t in GRID]
    return [{"value": t, "accuracy": a} for t, a in zip(GRID, rows.agg(*[c.alias(str(i)) for i, c in enumerate(right)]).first())]


def staged_run(spark: SparkSession, path: str, rows: DataFrame) -> tuple[DataFrame, stages.Stages]:
    """Prepared on train, chosen on val, refitted on both, applied to test; each stage is kept under path."""
    kept = stages.Stages(spark, path)
    part = lambda *names: rows.filter(F.col("split").isin(*names))
    own = {"rows": rows.select("sample_id", "split", "label", "score")}
    prepared = kept.run("prepare", {"floor": 1e-12}, own, lambda rows: _moments(part("train")))
    picked = kept.run("select", {"grid": GRID}, {"state": prepared}, lambda state: {"history": _history(part("val"), state)})
    threshold = stages.chosen(picked.result["history"], GRID, "value", "accuracy")
    refitted = kept.run("refit", {"threshold": threshold}, {"chosen": picked}, lambda chosen: _moments(part("train", "val")) | {"threshold": threshold})

    def apply(state):
        z = (F.col("score") - state["mean"]) / state["std"]
        return part("test").select("sample_id", F.round(z, 6).alias("z"), F.when(z > state["threshold"], "CONFIRM").otherwise("HOLD").alias("action"))

    return kept.run("apply", {}, {"state": refitted}, apply).result, kept


@query(sql("splits", f"""SELECT sample_id, round((score - mean) / std, 6) AS z, CASE WHEN (score - mean) / std > threshold THEN 'CONFIRM' ELSE 'HOLD' END AS action
    FROM frames JOIN splits USING (sequence_id), (SELECT avg(score) AS mean, greatest(stddev_pop(score), 1e-12) AS std FROM frames JOIN splits USING (sequence_id) WHERE split <> 'test'),
    (SELECT t AS threshold FROM (SELECT t, avg(CASE WHEN ((score - m) / s > t) = (label = 'hazard') THEN 1.0 ELSE 0.0 END) AS accuracy FROM frames JOIN splits USING (sequence_id),
      (SELECT avg(score) AS m, greatest(stddev_pop(score), 1e-12) AS s FROM frames JOIN splits USING (sequence_id) WHERE split = 'train'), (SELECT unnest({GRID}) AS t) WHERE split = 'val' GROUP BY t) ORDER BY accuracy DESC, t LIMIT 1)
    WHERE split = 'test'"""))
def refitted_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over the stages of the first one makes none of them again."""
    rows, path = alarms.split_frames(spark, sf_dir), scratch(spark, "stages")
    staged_run(spark, path, rows)
    out, again = staged_run(spark, path, rows)
    if again.made:
        raise stages.StageError(f"made again: {again.made}")
    return out


PLAN = {"thresholds": [60.0, 120.0, 240.0], "most": 0.2, "powered": 20}


def sealed_cells(test: DataFrame, plan: dict) -> DataFrame:
    """Share of test rows at or above each threshold, by scenario; passed where it is no more than allowed."""
    each = test.withColumn("threshold", F.explode(F.lit(plan["thresholds"])))
    out = each.groupBy("scenario_id", "threshold").agg(F.count("*").alias("n"), F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("share"))
    return out.withColumns({"status": F.when(F.col("share") <= plan["most"], "pass").otherwise("fail"), "powered": F.col("n") >= plan["powered"]})


_CELLS = """cells AS (SELECT scenario_id, threshold, count(*) AS n, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS share FROM frames JOIN splits USING (sequence_id), (SELECT unnest([60.0, 120.0, 240.0])::DOUBLE AS threshold)
    WHERE split = 'test' GROUP BY ALL)"""


@query(sql("splits", "").rstrip() + f", {_CELLS} SELECT scenario_id, threshold, n, round(share, 6) AS share, CASE WHEN share <= 0.2 THEN 'pass' ELSE 'fail' END AS status, n >= 20 AS powered FROM cells")
def sealed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda: alarms.split_frames(spark, sf_dir).filter("split = 'test'")
    out = stages.locked_evaluation(spark, scratch(spark, "sealed"), PLAN, rows, sealed_cells)
    return out.withColumn("share", F.round("share", 6))


@query(sql("splits", "").rstrip() + f""", {_CELLS} SELECT count(*) AS n_cells, count(*) FILTER (share <= 0.2) AS n_pass, count(*) FILTER (n >= 20) AS n_gated,
    CASE WHEN count(*) FILTER (n >= 20) = 0 THEN 'open' WHEN bool_and(share <= 0.2) FILTER (n >= 20) THEN 'pass' ELSE 'fail' END AS verdict FROM cells""")
def sealed_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.verdict(sealed_evaluation(spark, sf_dir), "powered")
