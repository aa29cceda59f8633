"""Runs in stages that are taken up where they stopped, choices recovered from what was saved, and evaluations that are
sealed before any test row is read.

A stage is keyed by a digest of its name, settings and inputs, where an input is another stage or a table (by a digest of
its contents that no order of rows changes). Its result, a table or a JSON value, is written aside by Spark and counts from
the moment a small marker file names it, so a run that is killed leaves whole stages or none of one. A later run with the
same key reads what is there; any change of a setting or an input is another key, and so are all stages behind it."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import canonical_json, create, exists, put, read_bytes, sanitized, sha256_json


class StageError(ValueError):
    """Saved stages that are incomplete or contradict each other."""


class SealError(ValueError):
    """An evaluation that is not the one that was sealed."""


def contents(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order and partitions: number and sum of row hashes."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    n, a, b = df.select(row.alias("h")).agg(F.count("*"), F.sum(part(1)), F.sum(part(16))).first()
    return sha256_json([names, [f.dataType.simpleString() for f in sorted(df.schema.fields, key=lambda f: f.name)], n, str(a), str(b)])


@dataclass(frozen=True)
class Done:
    """A stage as it stands: its key, and its result, a DataFrame or a JSON value."""

    key: str
    result: Any


class Stages:
    """Stages kept under a path of the shared store. made: names of those worked out by this run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.made = spark, path.rstrip("/"), []

    def _marker(self, key: str) -> str:
        return f"{self.path}/{key}.json"

    def _read(self, marker: dict) -> Any:
        if "value" in marker:
            return marker["value"]
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(marker["schema"])).parquet(f"{self.path}/{marker['table']}")

    def run(self, name: str, settings: dict, inputs: dict[str, "Done | DataFrame"], make: Callable[..., Any]) -> Done:
        """The stage, from the store if it is there, else by make(**inputs), which then is committed."""
        of = {k: x.key if isinstance(x, Done) else contents(x) for k, x in inputs.items()}
        key = sha256_json({"stage": name, "settings": settings, "inputs": of})
        if exists(self._marker(key)):
            return Done(key, self._read(json.loads(read_bytes(self._marker(key)))))
        out = make(**{k: x.result if isinstance(x, Done) else x for k, x in inputs.items()})
        if isinstance(out, DataFrame):
            table = f"{name}-{uuid.uuid4().hex}"
            out.write.option("compression", "zstd").parquet(f"{self.path}/{table}")
            marker = {"stage": name, "settings": settings, "inputs": of, "table": table, "schema": json.loads(out.schema.json())}
        else:
            marker = {"stage": name, "settings": settings, "inputs": of, "value": sanitized(out)}
        put(self._marker(key), canonical_json(marker).encode())
        self.made.append(name)
        return Done(key, self._read(marker))


def chosen(history: list[dict], grid: list, setting: str, criterion: str, saved: Any = None) -> Any:
    """The setting with the greatest criterion, the first one on ties, from the history of a selection alone. The history
    must hold the whole grid in its order, with finite criteria, and agree with the choice that was saved, if one is given."""
    if [h[setting] for h in history] != list(grid):
        raise StageError(f"the saved grid of {setting} is incomplete or another one")
    if not all(isinstance(h[criterion], int | float) and math.isfinite(h[criterion]) for h in history):
        raise StageError(f"a saved {criterion} is not finite")
    best = max(history, key=lambda h: h[criterion])[setting]
    if saved is not None and saved != best:
        raise StageError(f"the saved choice of {setting} contradicts its criterion")
    return best


class SolverState:
    """The last state of an iterative solver and a line for each, kept with the digest of the problem: a state of another
    problem is not taken up."""

    def __init__(self, path: str) -> None:
        self.path, self.lines = path.rstrip("/"), []

    def load(self, problem: str) -> dict | None:
        if not exists(f"{self.path}/last.json"):
            return None
        kept = json.loads(read_bytes(f"{self.path}/last.json"))
        if kept["problem"] != problem:
            raise StageError("the saved state is of another problem")
        self.lines = kept["trace"]
        return kept["state"]

    def save(self, problem: str, state: dict, note: dict) -> None:
        self.lines.append(note)
        put(f"{self.path}/last.json", canonical_json({"problem": problem, "state": state, "trace": self.lines}).encode())
        put(f"{self.path}/trace.jsonl", "".join(canonical_json(x) + "\n" for x in self.lines).encode())


def seal(path: str, plan: dict) -> str:
    """Bind an evaluation to its plan: the first one to come writes the seal, and whoever comes with another plan is
    refused. Returns the digest."""
    digest = sha256_json(plan)
    if create(path, canonical_json({"digest": digest, "plan": plan}).encode()):
        return digest
    try:
        kept = json.loads(read_bytes(path))
    except ValueError:
        raise SealError("the seal is not readable: a run may have died while it was set") from None
    if kept["digest"] != digest or sha256_json(kept["plan"]) != digest:
        raise SealError("the evaluation was sealed with another plan")
    return digest


def locked_evaluation(spark: SparkSession, path: str, plan: dict, test: Callable[[], DataFrame], cells: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """Cells of a grid on test rows, each with `status`, once. The plan is sealed before `test` is called; a run with the
    same plan reads what the first one found, one with another plan is refused before it reads a row."""
    digest = seal(f"{path}/seal.json", plan)
    kept = Stages(spark, path)
    return kept.run("evaluation", {"seal": digest}, {}, lambda: cells(test(), plan)).result


def verdict(cells: DataFrame, powered: str) -> DataFrame:
    """Cells counted by status; the verdict is of the cells whose control is powered, and open without any."""
    gated = cells.filter(powered)
    counted = cells.agg(F.count("*").alias("n_cells"), F.count_if(F.col("status") == "pass").alias("n_pass"))
    own = gated.agg(F.count("*").alias("n_gated"), F.coalesce(F.bool_and(F.col("status") == "pass"), F.lit(False)).alias("all_pass"))
    return counted.join(F.broadcast(own)).select("n_cells", "n_pass", "n_gated", F.when(F.col("n_gated") == 0, "open").when(F.col("all_pass"), "pass").otherwise("fail").alias("verdict"))
