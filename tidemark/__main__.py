"""Command line: python -m tidemark COMMAND --in PATH --out PATH [--model PATH] [--config PATH].

Commands: simulate, indicators, regimes, regimes-apply, embeddings, embeddings-apply, stability,
stability-apply, policies, reports."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import split_of
from tidemark.operators import embed, folds, hmm, regimes, spectra, windows
from tidemark.plans import config, report
from tidemark.sources import simulate, sinks

SIZE = len(spectra.SCALARS)


def _text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def _regimes(df: DataFrame, model: dict) -> DataFrame:
    scored = df.withColumn("distance", regimes.distance(F.col("x"), model))
    return regimes.apply_boundaries(scored, "distance", tuple(model["cuts"]))


def _observed(df: DataFrame) -> DataFrame:
    index = F.expr(" ".join(["CASE regime_label", *(f"WHEN '{s}' THEN {k}" for k, s in enumerate(hmm.STATES)), "END"]))
    return df.withColumn("obs", index).select("sequence_id", "timestamp", "sample_id", "obs", *(["z"] if "z" in df.columns else []))


def _stability(df: DataFrame, model: dict) -> DataFrame:
    state = hmm.with_persistence(hmm.infer(_observed(df), model), model, [0])
    alerts = windows.expectation_alerts(state, F.col("state_expectation"), F.col("state_mle"))
    keep = [c for c in ("label", "scenario_id", "regime_label", "risk_score") if c in df.columns]
    return alerts.join(df.select("sample_id", *keep), "sample_id")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = config.read(a.config) if a.config else {}
    df = None if a.command == "simulate" else spark.read.parquet(a.source)
    is_train = None if df is None or "sequence_id" not in df.columns else split_of(F.col("sequence_id")) == "train"
    if a.command == "simulate":
        out = simulate.simulate(spark, settings.get("sequences", 100), settings.get("frames", 10), settings.get("seed", 7), settings.get("episodes", False))
    elif a.command == "indicators":
        out = spectra.indicators(df, spectra.IndicatorConfig(**settings))
    elif a.command == "regimes":
        train = df.filter(is_train)
        model = regimes.fit_distance(train, "x", SIZE, F.col("label") == "hazard")
        scored = train.withColumn("distance", regimes.distance(F.col("x"), model))
        model["cuts"] = list(regimes.fit_boundaries(scored, "distance", F.col("label") == "hazard"))
        _text(spark, a.model, regimes.dump(model))
        out = _regimes(df, model)
    elif a.command == "regimes-apply":
        out = _regimes(df, regimes.load(_read_text(spark, a.model)))
    elif a.command == "embeddings":
        y = F.expr(" ".join(["CASE regime_label", *(f"WHEN '{s}' THEN {k}" for k, s in enumerate(hmm.STATES)), "END"]))
        model = embed.fit(df.withColumn("y", y), "x", "y", "risk_score", is_train, **settings)
        _text(spark, a.model, embed.dump(model))
        out = embed.apply(df, "x", model, [c for c in df.columns if c != "z"])
    elif a.command == "embeddings-apply":
        out = embed.apply(df, "x", json.loads(_read_text(spark, a.model)), [c for c in df.columns if c != "z"])
    elif a.command == "stability":
        model, _ = hmm.fit(_observed(df.filter(is_train)), **settings)
        _text(spark, a.model, hmm.dump(model))
        out = _stability(df, model)
    elif a.command == "stability-apply":
        out = _stability(df, hmm.load(_read_text(spark, a.model)))
    elif a.command == "policies":
        ready = hmm.policy_predicates(df)
        out = folds.policy(ready, **settings).join(ready.select("sample_id", "priority", "veto_codes", *[c for c in ("label", "p_confirmable", "persistence_seconds") if c in df.columns]), "sample_id")
    else:
        for name, text in report.reports(df).items():
            _text(spark, f"{a.out}/{name}", text)
        return
    sinks.write_parquet(out, a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("command", choices=["simulate", "indicators", "regimes", "regimes-apply", "embeddings", "embeddings-apply", "stability", "stability-apply", "policies", "reports"])
    p.add_argument("--in", dest="source")
    p.add_argument("--out", required=True)
    p.add_argument("--model")
    p.add_argument("--config")
    run(spark or SparkSession.builder.appName("tidemark").getOrCreate(), p.parse_args(argv))


if __name__ == "__main__":
    main()
