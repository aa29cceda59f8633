"""NumPy archives as a data source of Spark: `spark.read.format("npz")` and `df.write.format("npz")`.

A folder holds one archive for each task that wrote it; a reader makes a partition of every ROWS rows of every archive and
reads only the arrays of the columns asked for. Archives have no pickles, and pickles are refused. A writer's task puts its
archive beside its name and the commit of the job, which names the parts that count in `_parts.json`, comes last, so parts
of lost or repeated tasks are never read.

Archives are files that NumPy opens, so the path is one that all executors see under the same name (a mounted folder);
elsewhere, as in an object store, `frames.read_npz` takes whole archives through Spark's own reader."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a partition of a reader, and of an archive of a writer, at most.
ROWS = 50_000
SHAPE = "sample_id string, label string, wavelengths array<double>, spectrum array<double>"


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not a folder that NumPy can open: {path}")
    return path.removeprefix("file://")


@dataclass
class _Rows(InputPartition):
    file: str
    low: int
    high: int


@dataclass
class _Part(WriterCommitMessage):
    files: list
    rows: int


def _length(file: str) -> int:
    """Rows of an archive, from the header of one array alone."""
    import zipfile

    import numpy as np

    with zipfile.ZipFile(file) as z, z.open("sample_id.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError(f"{file} holds pickled objects")
    return shape[0]


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            files = [self.path]
        else:
            listed = os.path.join(self.path, "_parts.json")
            names = json.load(open(listed)) if os.path.exists(listed) else sorted(x for x in os.listdir(self.path) if x.endswith(".npz"))
            files = [os.path.join(self.path, x) for x in names]
        return [_Rows(f, low, low + ROWS) for f in files for low in range(0, _length(f), ROWS)] or [_Rows("", 0, 0)]

    def read(self, partition: _Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not partition.file:
            return
        with np.load(partition.file, allow_pickle=False) as z:
            n = len(z["sample_id"][partition.low : partition.high])
            columns = []
            for name in self.names:
                if name == "wavelengths":
                    grid = z[name]
                    rows = np.broadcast_to(grid, (n, grid.shape[-1])) if grid.ndim == 1 else grid[partition.low : partition.high]
                    columns.append(pa.array(rows.astype(float).tolist(), pa.list_(pa.float64())))
                elif name == "spectrum":
                    columns.append(pa.array(z[name][partition.low : partition.high].astype(float).tolist(), pa.list_(pa.float64())))
                elif name in z:
                    own = z[name][partition.low : partition.high].astype(str).tolist()
                    missing = z["label_missing"][partition.low : partition.high].tolist() if name == "label" and "label_missing" in z else [False] * n
                    columns.append(pa.array([None if gone else x for x, gone in zip(own, missing)], pa.string()))
                else:
                    columns.append(pa.nulls(n, pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=self.names)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def _put(self, name: str, rows: list) -> None:
        import numpy as np

        aside = os.path.join(self.path, f".{name}.{uuid.uuid4().hex}.npz")
        np.savez(
            aside, sample_id=np.array([r["sample_id"] for r in rows], str), label=np.array([r["label"] or "" for r in rows], str),
            label_missing=np.array([r["label"] is None for r in rows]), wavelengths=np.array([r["wavelengths"] for r in rows], float), spectrum=np.array([r["spectrum"] for r in rows], float),
        )
        os.replace(aside, os.path.join(self.path, name))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        files, held, total = [], [], 0
        for row in iterator:
            held.append(row)
            total += 1
            if len(held) == ROWS:
                files.append(f"part-{uuid.uuid4().hex}.npz")
                self._put(files[-1], held)
                held = []
        if held:
            files.append(f"part-{uuid.uuid4().hex}.npz")
            self._put(files[-1], held)
        return _Part(files, total)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        listed, before = os.path.join(self.path, "_parts.json"), []
        if not self.overwrite and os.path.exists(listed):
            before = json.load(open(listed))
        aside = f"{listed}.{uuid.uuid4().hex}"
        with open(aside, "w") as f:
            json.dump(before + sorted(x for m in messages if m for x in m.files), f)
        os.replace(aside, listed)

    def abort(self, messages: list) -> None:
        for m in messages:
            for x in m.files if m else []:
                if os.path.exists(os.path.join(self.path, x)):
                    os.remove(os.path.join(self.path, x))


class Archives(DataSource):
    """Rows of sample_id, label, wavelengths, spectrum; all vectors of an archive are of one length."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_local(self.options["path"]), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if {f.name for f in schema.fields} != {"sample_id", "label", "wavelengths", "spectrum"}:
            raise ValueError(f"an archive takes {SHAPE}")
        return _Writer(_local(self.options["path"]), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
