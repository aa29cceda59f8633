"""Secret scan with an incremental blob ledger.

Every version of a text is addressed by its content, the SHA-256 of its bytes. The ledger is a table of
(blob, rules, spans): what each blob was scanned for, and what was found. An update works out which pairs of blob and
rule version the ledger doesn't have yet, scans one text of each such blob for those rules alone, and appends a row. So
a text that was seen at another path, in another version or an earlier run is never scanned again, and a new version of
a rule scans for that rule only. Findings go back to all paths by a join on the blob.

Scale: texts of a first run are moved once, a text for each blob and task. A later run first makes the pairs still open
from digests alone; if they are few (SENT blobs), texts are filtered where they are read. Blobs that hold over a
thousandth of all rows, a thousand at most, are salted in the join back. A run that is cut short leaves whole rows in the
ledger; the next one scans what is missing.

Defined cases: a null text is empty and has no findings. Ids may be null; repeated rows each get the findings. An empty
table gives no rows, and a ledger no rows. Rows of the ledger that say the same (two updates at once) count once. Spans
are code points, the end exclusive; of one rule they never overlap. A very long text is scanned whole. Extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Blobs still open that are sent to all executors at most; rows over 1 / HOT_SHARE of all share a blob: salted.
SENT = 100_000
HOT_SHARE, SALTS = 1000, 64

SPANS = "array<struct<rule: string, start: bigint, end: bigint>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """pattern is searched leftmost first; matches whose group has fewer than `least` characters are passed over.
    needed: texts that hold none of these, in lower case, can't match."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    needed: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"

    def find(self, text: str, lower: str) -> Iterator[tuple[int, int]]:
        if self.needed and not any(x in lower for x in self.needed):
            return
        for m in re.finditer(self.pattern, text, re.ASCII):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()


#: Published forms of credentials. The first three are the base, in this order.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, needed=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needed=("-----begin ",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needed=("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needed=("gh",)),
    Rule("google", 1, r"AIza[0-9A-Za-z_-]{35}", needed=("aiza",)),
    Rule("slack", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}", needed=("xox",)),
)


def scan(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(id of the rule, start, end) of all findings of some rules in a text."""
    lower = text.lower()
    return [(r.id, start, end) for r in rules for start, end in r.find(text, lower)]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _scanned(batches, rules: tuple[Rule, ...]):
    import pyarrow as pa

    span = pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        spans = []
        for text, ids in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist()):
            found = scan(text, tuple(r for r in rules if r.id in ids))
            spans.append([{"rule": a, "start": b, "end": c} for a, b, c in found])
        yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(spans, pa.list_(span))], names=["blob", "rules", "spans"])


class Ledger:
    """The table of blobs at a path of a shared store; the path need not be there yet."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        if len({r.name for r in rules}) != len(rules):
            raise ValueError("two rules of one name")
        self.spark, self.path, self.rules = spark, path, rules
        self.ids = [r.id for r in rules]

    def rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def open_pairs(self, blobs: DataFrame) -> DataFrame:
        """Distinct blobs with the rule versions they weren't scanned for yet; those without any are left out."""
        done = self.rows().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        missing = F.when(F.col("done").isNull(), F.lit(self.ids)).otherwise(F.array_except(F.lit(self.ids), F.col("done")))
        return blobs.select("blob").distinct().join(done, "blob", "left").select("blob", missing.alias("rules")).filter(F.size("rules") > 0)

    def update(self, docs: DataFrame, text: str = "text") -> int:
        """Scan the versions in docs for what is open; the number of blobs scanned."""
        versions = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        one = F.first("text").alias("text")
        before = self.rows().count()
        if not before:
            todo = versions.groupBy("blob").agg(one).withColumn("rules", F.lit(self.ids))
        else:
            pairs = materialize(self.open_pairs(versions), "open")
            if pairs.count() <= SENT:
                todo = versions.join(F.broadcast(pairs), "blob").groupBy("blob", "rules").agg(one)
            else:
                todo = versions.groupBy("blob").agg(one).join(pairs, "blob")
        scanned = todo.select("blob", "rules", "text").mapInArrow(partial(_scanned, rules=self.rules), LEDGER)
        scanned.write.mode("append").option("compression", "zstd").parquet(self.path)
        return self.rows().count() - before

    def findings(self) -> DataFrame:
        """blob, spans by the rules of this ledger; blobs without any are left out."""
        own = self.rows().select("blob", F.filter("spans", lambda s: s["rule"].isin(self.ids)).alias("spans")).filter(F.size("spans") > 0)
        merged = own.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        placed = F.transform("spans", lambda s: F.struct(s["start"], F.array_position(F.lit(self.ids), s["rule"]).alias("at"), s["end"]))
        name = lambda s: F.element_at(F.lit([r.name for r in self.rules]), s["at"].cast("int"))
        return merged.select("blob", F.transform(F.array_sort(placed), lambda s: F.struct(name(s).alias("rule"), s["start"], s["end"])).alias("spans"))

    def by_path(self, docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
        """path, blob and spans (empty where there are none) of all rows of docs."""
        paths = materialize(docs.select(path, blob_of(F.col(text)).alias("blob")), "paths")
        counted = paths.groupBy("blob").agg(F.count("*").alias("n"))
        hot = materialize(counted.filter(F.col("n") * HOT_SHARE > paths.count()).select("blob", F.lit(SALTS).alias("salts")), "hot")
        salts = F.coalesce("salts", F.lit(1))
        dealt = paths.join(F.broadcast(hot), "blob", "left").withColumn("salt", (F.rand(0) * salts).cast("int")).drop("salts")
        found = self.findings().join(F.broadcast(hot), "blob", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return dealt.join(found, ["blob", "salt"], "left").select(path, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
