"""Contracts, joins, splits, sinks, configurations, reports, streaming."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import keys, scalars
from tidemark.operators import contracts, folds, joins
from tidemark.plans import config, report
from tidemark.sources import frames, sinks
from tidemark.streaming import stateful


def test_splits_equal_hashlib(spark):
    ids = [f"seq_{i}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", keys.bucket1000(F.col("id")).alias("b"), keys.fraction(F.col("id"), 7).alias("f"), keys.derived_seed("ns", F.col("id")).alias("s"))
    for r in df.collect():
        assert r.b == int(hashlib.sha256(r.id.encode()).hexdigest(), 16) % 1000
        assert r.f == int.from_bytes(hashlib.sha256(f"7:{r.id}".encode()).digest()[:8], "big") / 2**64
        assert r.s == keys.seed_for("ns", r.id)


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1.0, [0.5, 0.5]), ("b", float("nan"), [0.7, 0.7]), ("a", None, [1.5, -0.5])], "k string, x double, p array<double>")
    with pytest.raises(contracts.ContractError, match="repeated k: a"):
        contracts.require_unique(df, "k")
    with pytest.raises(contracts.ContractError, match="x"):
        contracts.require_finite(df, ["x"])
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.require_columns(df, ["y"])
    with pytest.raises(contracts.ContractError, match="unexpected"):
        contracts.allow_only(df, ["k"])
    with pytest.raises(contracts.ContractError, match="prohibited"):
        contracts.allow_only(df, ["k", "x", "p"], ["x"])
    assert [r.ok for r in df.select(contracts.is_probability(F.col("p")).alias("ok")).collect()] == [True, False, False]
    grids = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0, 4.0],), ([1.0, 1.0, 1.0],)], "g array<double>")
    assert [r.ok for r in grids.select(contracts.is_uniform_grid(F.col("g")).alias("ok")).collect()] == [True, False, False]
    with pytest.raises(contracts.ContractError):
        contracts.require_one_grid(grids, "g")
    times = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "timestamp double, t double")
    assert [r.timestamp for r in contracts.unify_time(times).collect()] == [1.0, 2.0]
    with pytest.raises(contracts.ContractError):
        contracts.unify_time(spark.createDataFrame([(1.0, 3.0)], "timestamp double, t double"))
    ok = spark.createDataFrame([([0.1, float("nan"), 0.9, 1.0],)], "s array<double>").select(contracts.valid_channels(F.col("s"), 0.0, 1.0).alias("v"), contracts.evaluable(F.col("s"), 0.0, 1.0).alias("e")).first()
    assert ok.v == [0, 2] and not ok.e
    seq = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5), ("b", 2, 0.1)], "sequence_id string, position int, timestamp double")
    assert contracts.time_breaks(seq).count() == 1


def test_joins(spark):
    a = spark.createDataFrame([("x", 1, "m"), ("y", 2, "n")], "k string, v int, meta string")
    b = spark.createDataFrame([("x", 3.0, "m"), ("y", 4.0, "n")], "k string, w double, meta string")
    assert joins.join_one_to_one(a, b, "k", ["meta"]).count() == 2
    for bad in (b.limit(1), b.union(b), b.withColumn("meta", F.lit("q"))):
        with pytest.raises(contracts.ContractError):
            joins.join_one_to_one(a, bad, "k", ["meta"])
    with pytest.raises(contracts.ContractError):
        joins.backfill(a, b.filter("k = 'x'"), "k", "w")
    same = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert joins.join_consistent(a, same, ["k"], ["v"]).columns == ["k", "v", "meta"]
    with pytest.raises(contracts.ContractError):
        joins.join_consistent(a, same.withColumn("v", F.col("v") + 1), ["k"], ["v"])
    edges = [0.0, 0.1, 0.3]
    x = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.4)], "v double")
    assert [r.b for r in x.select(joins.right_closed_stratum(F.col("v"), edges).alias("b")).collect()] == [None, 0, 1, 1, 1, None]
    assert [r.b for r in x.select(joins.half_open_bin(F.col("v"), edges).alias("b")).collect()] == [0, 1, 1, 1, None, None]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.float_text(F.lit(1.5)).alias("a"), scalars.float_text(F.lit(2.0)).alias("b"), scalars.alert_token(F.lit(" degrading-fast now ")).alias("c"),
        scalars.clip(F.lit(float("nan")), 0, 1).alias("d"), scalars.reason_codes(F.lit('["A","B"]')).alias("e"), scalars.reason_codes(F.lit("A; B|C,")).alias("f"),
        scalars.toggle_reduction(F.lit(1.0), F.lit(4.0)).alias("g"), scalars.argmax_first(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("h"), scalars.null_if_not_finite(F.lit(float("inf"))).alias("i"),
        scalars.log1p_exp(F.lit(800.0)).alias("j"),
    ).first()
    assert tuple(row) == ("1.5", "2", "DEGRADING_FAST_NOW", 0.0, ["A", "B"], ["A", "B", "C"], 0.75, 0, None, 800.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a_b", [1.0, 2.0], [0.1, 0.2]), ("s2", None, [1.0, 2.0], [0.3, float("nan")])], "sample_id string, label string, wavelengths array<double>, spectrum array<double>")
    sinks.write_npz(df, str(tmp_path / "x.npz"))
    back = frames.read_npz(spark, str(tmp_path / "x.npz")).orderBy("sample_id").collect()
    assert [r.sample_id for r in back] == ["s1", "s2"] and back[0].spectrum == [0.1, 0.2]
    sinks.write_json(tmp_path / "j.json", {"a": float("nan"), "b": [1.0, float("inf")]})
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": None, "b": [1.0, None]}
    sinks.manifest(tmp_path / "m.json", {"x": 1}, {"in": "h"}, {"j": tmp_path / "j.json"})
    assert sinks.verify_manifest(tmp_path / "m.json", {"j": tmp_path / "j.json"}) == []
    (tmp_path / "j.json").write_text("{}")
    assert sinks.verify_manifest(tmp_path / "m.json", {"j": tmp_path / "j.json"}) == ["j"]
    small = spark.createDataFrame([("a_b", 0.5), ("c", None)], "n string, v double")
    assert "| a_b | 0.500000 |" in sinks.markdown_table(small) and "| c | NA |" in sinks.markdown_table(small)
    assert r"a\_b & 0.500000 \\" in sinks.latex_table(small)
    sinks.write_csv(small, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_parquet(small.withColumn("scenario_id", F.col("n")), str(tmp_path / "p.parquet"), ("scenario_id",))
    assert frames.discover_scenarios(spark, str(tmp_path / "p.parquet"), ["c"]).count() == 1
    with pytest.raises(ValueError):
        frames.read_parquet_frame(spark, "x.csv")


def test_config():
    schema = {"type": "object", "properties": {"a": {"type": "number", "minimum": 0, "default": 1}, "b": {"type": "object", "properties": {"c": {"type": "string", "enum": ["x"]}}, "required": ["c"]}}}
    assert config.validate({"b": {"c": "x"}}, schema) == {"a": 1, "b": {"c": "x"}}
    for bad in ({"z": 1}, {"a": -1}, {"a": True}, {"b": {}}, {"b": {"c": "y"}}):
        with pytest.raises(config.ConfigError):
            config.validate(bad, schema)
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.complexity({"a": {"b": 1, "c": [1, 2]}}) == 3


def _frames(spark, seed=0, n=8, length=30):
    rng = random.Random(seed)
    rows = [(f"s{i}", float(t), f"{i:02d}{t:03d}", rng.expovariate(1 / 60)) for i in range(n) for t in range(length)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "sequence_id string, timestamp double, sample_id string, score double")


def test_report(spark):
    actions = folds.hysteresis(_frames(spark), 120.0, 30.0, 3)
    out = report.reports(actions)
    assert "CONFIRM" in out["operator"] or "HOLD" in out["operator"] or "RESCAN" in out["operator"]
    values = report.summary(actions).first().asDict()
    with pytest.raises(report.ReportError):
        report.check(out["operator"] + " guaranteed", values)
    with pytest.raises(report.ReportError):
        report.check(out["operator"] + " 987654321", values)
    with pytest.raises(report.ReportError):
        report.render("{{ nothing }}", values)


@pytest.mark.parametrize("kind", ["ewma", "hysteresis", "nofm", "policy", "two_state"])
def test_stream_equals_batch(spark, tmp_path, kind):
    """Rows arrive in three files, in order; the stream's actions are those of the batch folds."""
    df = _frames(spark).withColumn("score", F.col("score") / 50 - 1) if kind == "two_state" else _frames(spark)
    flags = df.withColumns({"veto": F.col("score") >= 300, "confirm_ok": F.col("score") >= 80, "rescan_ok": F.col("score") >= 30})
    operator, batch = {
        "ewma": lambda: (stateful.ewma_cusum(0.2, 60.0, 250.0, 90.0), folds.ewma_cusum(df, 0.2, 60.0, 250.0, 90.0)),
        "hysteresis": lambda: (stateful.hysteresis(120.0, 30.0, 3), folds.hysteresis(df, 120.0, 30.0, 3)),
        "nofm": lambda: (stateful.n_of_m(3, 5, 60.0, 2), folds.n_of_m(df, 3, 5, 60.0, 2)),
        "policy": lambda: (stateful.policy(80.0, 30.0, 300.0), folds.policy(flags)),
        "two_state": lambda: (stateful.two_state(0.1), folds.two_state_filter(df, 0.1).withColumn("action", F.when(F.col("posterior") > 0.9, "CONFIRM").otherwise("HOLD"))),
    }[kind]()
    for k in range(3):
        part = df.filter((F.col("timestamp") >= 10 * k) & (F.col("timestamp") < 10 * (k + 1))).coalesce(1)
        part.write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"out_{kind}"
    q = stateful.run(stream, operator).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.sample_id: r.action for r in spark.table(name).collect()}
    assert got == {r.sample_id: r.action for r in batch.collect()}


def test_time_breaks_with_long_ids_and_ties(spark, tmp_path):
    import datetime

    import duckdb

    from tidemark.plans import contract_queries, registry

    day = datetime.datetime(2024, 1, 1)
    rows = [(k * 1_000_000_007 + e, day + datetime.timedelta(seconds=(e * 37 + k) % 101), e % 3, "click", 0.5, None) for k in range(3) for e in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/a/events.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/a/events.parquet/*.parquet')")
    want = duckdb.sql(registry.ORACLES["time_breaks"]).fetchall()
    assert sorted(map(tuple, contract_queries.time_breaks(spark, f"{tmp_path}/a").collect())) == sorted(want)
    tied = [(e * 1_000_003, day + datetime.timedelta(seconds=s), 1, "click", 0.5, None) for e, s in enumerate((1, 5, 2, 3))]  # all at one place
    for name, order in (("b", tied), ("c", tied[::-1])):
        spark.createDataFrame(order, df.schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert [tuple(r) for r in contract_queries.time_breaks(spark, f"{tmp_path}/{name}").collect()] == [("1", 1)]


def test_time_breaks_with_an_id_missing(spark, tmp_path):
    """A frame without a place stands last, as SQL has it."""
    import datetime

    import duckdb

    from tidemark.plans import contract_queries, registry

    day = datetime.datetime(2024, 1, 1)
    rows = [(e, day + datetime.timedelta(seconds=s), u, "click", 0.5, None) for u, order in ((1, ((None, 9), (1, 2), (2, 5))), (2, ((None, 1), (3, 2), (4, 5))), (None, ((5, 3), (6, 1)))) for e, s in order]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = duckdb.sql(registry.ORACLES["time_breaks"]).fetchall()
    assert set(map(tuple, contract_queries.time_breaks(spark, str(tmp_path)).collect())) == set(want) == {("2", 1), (None, 1)}
