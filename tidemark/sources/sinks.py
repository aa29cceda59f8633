"""Sinks: Parquet with a manifest, strict JSON, CSV, Markdown and LaTeX tables, NumPy archives, bundles.

Tables of any size are written by Spark. What the driver writes as text is a small result."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def sanitized(value: Any) -> Any:
    """The value as JSON has it, with null for numbers that are not finite."""
    plain = lambda x: x.tolist() if hasattr(x, "tolist") else str(x)
    return json.loads(json.dumps(value, default=plain), parse_constant=lambda _: None)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256_json(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def put(path: str | Path, data: bytes) -> None:
    """Some bytes to a place in any store that Spark knows, or on this machine where the path names no store. They
    appear under their name when they are whole."""
    path = str(path)
    if "://" not in path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
            f.write(data)
        os.replace(f.name, path)
        return
    spark = SparkSession.getActiveSession()
    name = spark._jvm.org.apache.hadoop.fs.Path
    store = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = name(f"{path}.{uuid.uuid4().hex}")
    out = store.create(aside)
    out.write(bytearray(data))
    out.close()
    store.delete(name(path), False)
    if not store.rename(aside, name(path)):
        raise OSError(f"{path} could not be put in place")


def _store(path: str):
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str | Path) -> bool:
    if "://" not in str(path):
        return os.path.exists(path)
    where, store = _store(str(path))
    return store.exists(where)


def read_bytes(path: str | Path) -> bytes:
    """A small file of any store."""
    if "://" not in str(path):
        return Path(path).read_bytes()
    where, store = _store(str(path))
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def create(path: str | Path, data: bytes) -> bool:
    """A new file; False, and nothing is written, where there is one by that name."""
    path = str(path)
    if "://" not in path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        try:
            with open(path, "xb") as f:
                f.write(data)
        except FileExistsError:
            return False
        return True
    where, store = _store(path)
    if not store.createNewFile(where):
        return False
    out = store.create(where, True)
    out.write(bytearray(data))
    out.close()
    return True


def write_json(path: str | Path, value: Any) -> None:
    put(path, (json.dumps(sanitized(value), indent=2, sort_keys=True) + "\n").encode())


def append_line(path: str | Path, record: dict) -> None:
    with Path(path).open("a") as f:
        f.write(canonical_json(sanitized(record)) + "\n")


def manifest(path: str | Path, config: dict, inputs: dict[str, str], artifacts: dict[str, str | Path]) -> dict:
    """Configuration, its hash, input and artifact hashes, and when; written as JSON."""
    out = {
        "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "config": config, "config_hash": sha256_json(config),
        "input_hash": sha256_json(inputs), "artifacts": {k: sha256_file(v) for k, v in sorted(artifacts.items())},
    }
    write_json(path, out)
    return out


def verify_manifest(path: str | Path, artifacts: dict[str, str | Path]) -> list[str]:
    """Names of artifacts that differ from the manifest."""
    known = json.loads(Path(path).read_text())["artifacts"]
    return sorted(k for k, v in artifacts.items() if known.get(k) != sha256_file(v))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def _cell(x: Any) -> str:
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return "NA"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


#: Rows that a table in a text, or an archive, may have.
SMALL = 100_000


def _small(df: DataFrame) -> list:
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"more than {SMALL} rows are a table for Spark to write, not a text")
    return rows


def markdown_table(df: DataFrame) -> str:
    rows = [[_cell(x) for x in r] for r in _small(df)]
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(r) + " |" for r in rows)]) + "\n"


_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_latex(text: str) -> str:
    return "".join(_LATEX.get(c, c) for c in text)


def latex_table(df: DataFrame) -> str:
    rows = [" & ".join(escape_latex(_cell(x)) for x in r) + r" \\" for r in _small(df)]
    head = " & ".join(escape_latex(c) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", head, r"\hline", *rows, r"\hline", r"\end{tabular}"]) + "\n"


def write_npz(df: DataFrame, path: str) -> None:
    """Spectra of a small table as a NumPy archive without pickles."""
    import io

    import numpy as np

    rows, held = _small(df.select("sample_id", "label", "wavelengths", "spectrum")), io.BytesIO()
    np.savez(
        held, sample_id=np.array([r["sample_id"] for r in rows], str), label=np.array([r["label"] or "" for r in rows], str),
        wavelengths=np.array([r["wavelengths"] for r in rows]), spectrum=np.array([r["spectrum"] for r in rows]),
    )
    put(path, held.getvalue())
