"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space and \t \n \v \f \r, as `bytes.split()` has it too.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a session that is
    one process (local mode, as in tests) sets a temporary folder; a cluster has none to offer."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, its lineage is cut, and it
    outlives any executor. `path_of` gives the folder, `drop` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove materialized tables that no later plan reads."""
    for df in frames:
        spark, path = df.sparkSession, df._tidemark_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words(text):
    """Array of the words of a text column; null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def as_columns(df: DataFrame) -> list:
    """The columns of df, whatever is in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def hashable(df: DataFrame) -> list:
    """The same for hashing: maps, which have no hash, as JSON."""
    return [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(as_columns(df), df.schema.fields)]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
