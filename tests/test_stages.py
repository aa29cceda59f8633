"""Stages that survive a kill, choices from histories, solver states taken up, sealed evaluations."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators import transport
from tidemark.plans import alarms, stage_queries, stages


class Killed(Exception):
    pass


@pytest.fixture(params=["local", "store"])
def folder(request, tmp_path):
    return str(tmp_path / "kept") if request.param == "local" else f"file://{tmp_path}/kept"


def test_a_run_killed_in_each_stage_ends_the_same(spark, tmp_path, monkeypatch):
    rows = alarms.split_frames(spark, SMALL).cache()
    whole, first = stage_queries.staged_run(spark, str(tmp_path / "whole"), rows)
    assert first.made == ["prepare", "select", "refit", "apply"]
    want, put = stages.contents(whole), stages.put
    for k in range(4):
        path, done = str(tmp_path / f"killed{k}"), []

        def dies(where, data, done=done, k=k):
            if len(done) == k:
                raise Killed  # the result is written, its marker isn't
            done.append(put(where, data))

        monkeypatch.setattr(stages, "put", dies)
        with pytest.raises(Killed):
            stage_queries.staged_run(spark, path, rows)
        monkeypatch.setattr(stages, "put", put)
        out, again = stage_queries.staged_run(spark, path, rows)
        assert again.made == first.made[k:]
        assert stages.contents(out) == want
        markers = lambda p: {f.name: {x: y for x, y in json.loads(f.read_text()).items() if x != "table"} for f in Path(p).glob("*.json")}
        assert markers(path) == markers(tmp_path / "whole")


def test_other_settings_and_inputs_are_other_stages(spark, folder):
    kept = stages.Stages(spark, folder)
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    one = kept.run("double", {"a": 1}, {"df": df}, lambda df: df.withColumn("y", F.col("x") * 2))
    assert kept.run("double", {"a": 1}, {"df": df.repartition(3)}, lambda df: 1 / 0).key == one.key
    assert one.result.agg(F.sum("y")).first()[0] == 40
    assert kept.run("double", {"a": 2}, {"df": df}, lambda df: 7).result == 7
    assert kept.run("double", {"a": 1}, {"df": df.filter("id > 0")}, lambda df: 8).result == 8
    assert kept.run("next", {}, {"one": one}, lambda one: {"rows": one.count()}).result == {"rows": 5}
    assert stages.contents(df) != stages.contents(df.union(df.limit(1)))
    assert stages.contents(df.select("x", "id")) == stages.contents(df)


def test_chosen():
    history = [{"v": 1, "c": 0.5}, {"v": 2, "c": 0.9}, {"v": 3, "c": 0.9}]
    assert stages.chosen(history, [1, 2, 3], "v", "c") == 2
    assert stages.chosen(history, [1, 2, 3], "v", "c", saved=2) == 2
    for bad in (lambda: stages.chosen(history, [1, 2], "v", "c"), lambda: stages.chosen(history, [1, 2, 3], "v", "c", saved=3), lambda: stages.chosen([{"v": 1, "c": float("nan")}], [1], "v", "c"), lambda: stages.chosen([{"v": 1, "c": None}], [1], "v", "c")):
        with pytest.raises(stages.StageError):
            bad()


def test_solver_is_taken_up_where_it_stopped(spark, folder):
    rng = np.random.default_rng(0)
    h, b = rng.normal(size=(20, 2)), rng.normal(0.7, 1, size=(25, 2))
    plain = transport.potentials(h, b, 0.3)
    steps = stages.SolverState(f"{folder}/whole")
    whole = transport.potentials(h, b, 0.3, state=steps)
    assert whole == plain and len(steps.lines) > 3
    for k in range(1, len(steps.lines)):

        class Dies(stages.SolverState):
            def save(self, problem, state, note, k=k):
                super().save(problem, state, note)
                if len(self.lines) == k:
                    raise Killed

        with pytest.raises(Killed):
            transport.potentials(h, b, 0.3, state=Dies(f"{folder}/{k}"))
        again = stages.SolverState(f"{folder}/{k}")
        assert transport.potentials(h, b, 0.3, state=again) == plain
        assert again.lines == steps.lines
    with pytest.raises(stages.StageError):
        transport.potentials(h, b, 0.4, state=stages.SolverState(f"{folder}/whole"))


def test_sealed_evaluation_is_refused_under_another_plan(spark, folder):
    rows = spark.createDataFrame([("a", 10.0 * i) for i in range(30)], "scenario_id string, score double")
    out = stages.locked_evaluation(spark, folder, stage_queries.PLAN, lambda: rows, stage_queries.sealed_cells)
    assert {(r.threshold, r.n, r.status) for r in out.collect()} == {(60.0, 30, "fail"), (120.0, 30, "fail"), (240.0, 30, "pass")}
    again = stages.locked_evaluation(spark, folder, stage_queries.PLAN, lambda: 1 / 0, stage_queries.sealed_cells)  # reads no test row
    assert again.count() == 3
    with pytest.raises(stages.SealError):
        stages.locked_evaluation(spark, folder, stage_queries.PLAN | {"most": 0.9}, lambda: 1 / 0, stage_queries.sealed_cells)
    assert stages.verdict(out, "threshold > 200").first().verdict == "pass"
    assert stages.verdict(out, "n > 99").first().verdict == "open"


def test_a_seal_is_set_once(spark, folder):
    assert stages.seal(f"{folder}/s.json", {"a": 1}) == stages.seal(f"{folder}/s.json", {"a": 1})
    with pytest.raises(stages.SealError):
        stages.seal(f"{folder}/s.json", {"a": 2})
    stages.create(f"{folder}/empty.json", b"")
    with pytest.raises(stages.SealError):
        stages.seal(f"{folder}/empty.json", {"a": 1})


def test_buckets_are_folded_in_generated_code(spark):
    """The bucket of an id is its digest modulo 1000, told without an array of digits for each row."""
    import hashlib

    from tidemark.functions.keys import bucket1000

    ids = spark.range(500).selectExpr("cast(id * 7919 AS string) AS id").unionAll(spark.sql("SELECT ''")).unionAll(spark.sql("SELECT cast(NULL AS string)"))
    out = ids.select("id", bucket1000(ids["id"]).alias("b"))
    want = {i: int(hashlib.sha256(i.encode()).hexdigest(), 16) % 1000 for i in (r.id for r in ids.collect()) if i is not None}
    assert {r.id: r.b for r in out.collect()} == want | {None: None}
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
