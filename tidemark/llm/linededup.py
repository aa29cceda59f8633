"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. One pass over the lines builds a HyperLogLog sketch of
sites for each line hash; sketches of a line are merged by aggregation, in each task before the exchange,
so a line that stands everywhere is a few rows. Lines whose estimate is within BAND of the threshold get
an exact distinct count, for which alone (line, site) rows are made distinct; the rest are decided by the
estimate. Boilerplate lines then leave all documents.

Defined cases: a null text has no lines and stays null. Lines without a word are never boilerplate. Lines
are compared without white space at their ends. A null site is a site. Repeated rows count once per site.
An empty table gives an empty result. Other columns pass through `strip_lines`. A very long text is split
whole, and takes memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, as_columns, hashable, materialize

SPREAD = 8
#: Log2 of a sketch's registers, and the relative band around the threshold that is counted exactly:
#: over four standard errors of 1.04 / sqrt(2^12).
LOG_K = 12
BAND = 0.25


def _keys(text: Column) -> Column:
    """Hash pair of every line of a text, null for lines without a word."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"))))


def boilerplate(docs: DataFrame, site: str = "source", spread: int = SPREAD) -> DataFrame:
    """h, g (hashes of the line), rows, sites (exact where exact is true, else estimated)."""
    rows = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.explode(_keys(F.col("text"))).alias("key")).filter("key IS NOT NULL").select("site", "key.h", "key.g")
    sketched = rows.groupBy("h", "g").agg(F.count("*").alias("rows"), F.hll_sketch_agg("site", LOG_K).alias("sketch"))
    # a line in fewer rows than that is on fewer sites
    sketched = sketched.filter(F.col("rows") >= spread).select("h", "g", "rows", F.hll_sketch_estimate("sketch").alias("about"))
    sketched = materialize(sketched.filter(F.col("about") >= spread * (1 - BAND)), "sketches")
    near = sketched.filter(F.col("about") <= spread * (1 + BAND)).select("h", "g")
    exact = rows.join(near, ["h", "g"], "left_semi").distinct().groupBy("h", "g").agg(F.count("*").alias("counted"))
    told = sketched.join(exact, ["h", "g"], "left").select("h", "g", "rows", F.coalesce("counted", "about").alias("sites"), F.col("counted").isNotNull().alias("exact"))
    return materialize(told.filter(F.col("sites") >= spread), "boilerplate")


def strip_lines(docs: DataFrame, site: str = "source", spread: int = SPREAD) -> DataFrame:
    """docs with boilerplate lines taken out of text, plus n_lines and n_removed.

    Lines that go are found per document as positions, so whole texts are moved once at most: documents
    without such a line keep their text untouched, others are met by their list of positions."""
    known = boilerplate(docs, site, spread).select("h", "g")
    own = docs.select(F.struct(*as_columns(docs)).alias("row"), F.xxhash64(*hashable(docs)).alias("a"), F.hash(*hashable(docs)).alias("b"))
    lines = docs.select(F.xxhash64(*hashable(docs)).alias("a"), F.hash(*hashable(docs)).alias("b"), F.posexplode(_keys(F.col("text"))).alias("at", "key"))
    lines = lines.filter("key IS NOT NULL").select("a", "b", "at", "key.h", "key.g")
    going = materialize(lines.join(known, ["h", "g"], "left_semi").groupBy("a", "b").agg(F.collect_set("at").alias("going")), "going")
    split = F.split("row.text", "\n")
    kept = F.expr("array_join(filter(split(row.text, '\n'), (x, i) -> NOT array_contains(going, i)), '\n')")
    fields = [F.col("row").getField(c).alias(c) if c != "text" else F.when(F.col("going").isNull(), F.col("row.text")).otherwise(kept).alias("text") for c in docs.columns]
    return own.join(going, ["a", "b"], "left").select(
        *fields,
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("going").isNull(), 0).otherwise(F.size("going")).cast("long").alias("n_removed"),
    )
