"""NumPy archives through Spark's data source interface."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import archives


@pytest.fixture
def rows(spark):
    archives.register(spark)
    label = F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, "").otherwise("a")
    return spark.range(250).repartition(3).select(
        F.format_string("s%03d", "id").alias("sample_id"), label.alias("label"), F.lit([1.0, 2.0, 3.0]).alias("wavelengths"), F.array(*[F.col("id") + k / 4 for k in range(3)]).alias("spectrum"))


def test_round_trip_in_parts(spark, rows, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    rows.write.format("npz").mode("append").save(path)
    parts = json.load(open(tmp_path / "a/_parts.json"))
    assert len(parts) == 3
    back = spark.read.format("npz").load(path)
    assert back.rdd.getNumPartitions() == 3
    assert sorted(back.collect()) == sorted(rows.collect())
    assert sorted(r.sample_id for r in back.select("sample_id").collect()) == sorted(r.sample_id for r in rows.collect())
    np.savez(tmp_path / "a/part-of-a-lost-task.npz", sample_id=np.array(["x"]))
    assert spark.read.format("npz").load(path).count() == 250  # parts that no commit names don't count
    rows.limit(4).write.format("npz").mode("append").save(path)
    assert spark.read.format("npz").load(path).count() == 254
    rows.limit(5).write.format("npz").mode("overwrite").save(path)
    assert spark.read.format("npz").load(path).count() == 5


def test_partitions_by_rows_and_one_file(spark, rows, tmp_path, monkeypatch):
    np.savez(tmp_path / "one.npz", sample_id=np.array([f"s{i}" for i in range(90)]), wavelengths=np.arange(4.0), spectrum=np.ones((90, 4)))
    monkeypatch.setattr(archives, "ROWS", 40)
    reader = archives._Reader(str(tmp_path / "one.npz"), ["sample_id", "label", "wavelengths"])
    assert [(p.low, p.high) for p in reader.partitions()] == [(0, 40), (40, 80), (80, 120)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 90
    df = spark.read.format("npz").load(str(tmp_path / "one.npz"))
    assert {(r.label, tuple(r.wavelengths)) for r in df.collect()} == {(None, (0.0, 1.0, 2.0, 3.0))}


def test_pickles_and_stores_are_refused(spark, rows, tmp_path):
    np.savez(tmp_path / "bad.npz", sample_id=np.array(["a", 1], object), spectrum=np.ones((2, 2)), wavelengths=np.ones(2))
    with pytest.raises(ValueError):
        archives._Reader(str(tmp_path / "bad.npz"), ["sample_id"]).partitions()
    with pytest.raises(ValueError):
        archives._local("s3://bucket/x")


def test_no_rows(spark, rows, tmp_path):
    path = f"file://{tmp_path}/none"
    rows.limit(0).write.format("npz").mode("append").save(path)
    assert spark.read.format("npz").load(path).collect() == []
