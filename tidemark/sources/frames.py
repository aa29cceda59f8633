"""Frame tables: rows keyed by (sequence_id, timestamp, sample_id)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("sequence_id", "timestamp", "sample_id")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. A session that is one process may do
    without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, whatever executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a function over wide rows holds at a time.
SLICE = 256


def map_slices(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInPandas with frames of SLICE rows at most, so that memory does not grow with Spark's batches of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape, most = to_arrow_schema(StructType.fromDDL(schema)), SLICE

    def run(batches):
        import pyarrow as pa

        slices = (b.slice(i, most).to_pandas() for b in batches for i in range(0, b.num_rows, most))
        for out in f(slices):
            yield pa.RecordBatch.from_pandas(out, schema=shape, preserve_index=False)

    return df.mapInArrow(run, schema)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: the user is the sequence, time is seconds, errors are hazards."""
    return as_frames(read_table(spark, sf_dir, "events"))


def as_frames(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("user_id").cast("string").alias("sequence_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("sample_id"),
        F.when(F.col("event_type") == "error", "hazard").otherwise("benign").alias("label"),
        F.col("event_type").alias("scenario_id"),
        F.col("value").alias("score"),
        "props",
    )


def read_parquet_frame(spark: SparkSession, path: str) -> DataFrame:
    """Parquet alone is accepted, by suffix, as other suffixes mean another reader."""
    if not path.endswith(".parquet"):
        raise ValueError(f"not a .parquet path: {path}")
    return spark.read.parquet(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Spectra stored as NumPy archives: a row per first-axis entry. Pickled objects are refused."""

    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for data in b.column("content").to_pylist():
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    n = len(z["sample_id"])
                    grid = np.broadcast_to(np.atleast_2d(z["wavelengths"]), z["spectrum"].shape)
                    label = z["label"] if "label" in z else np.array([None] * n, object)
                    yield pa.RecordBatch.from_pydict({
                        "sample_id": [str(x) for x in z["sample_id"]],
                        "label": [None if x is None else str(x) for x in label],
                        "wavelengths": grid.astype(float).tolist(),
                        "spectrum": z["spectrum"].astype(float).tolist(),
                    })

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "sample_id string, label string, wavelengths array<double>, spectrum array<double>")


def discover_scenarios(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Tables written by scenario (partition column scenario_id); all or those named, by partition pruning."""
    df = spark.read.parquet(path)
    return df if names is None else df.filter(F.col("scenario_id").isin(names))
