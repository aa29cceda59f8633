import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import SHAPE, edge_docs, edge_rows, empty_docs, prose, words
from tidemark.llm import interaction
from tidemark.llm.queries import op13_filter_interaction_audit

LABELS = "doc_id long, quality int, toxic int"


def flags(rows):
    """The set of filters that each (doc_id, text) fails."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and i > first[t]
        out.append({f for f, bad in fails.items() if bad})
    return out


def simulated(rows, labels):
    """Every order applied document by document. rows: (doc_id, text, part)."""
    failing, out, removed = flags([r[:2] for r in rows]), Counter(), Counter()
    parts = {r[2] or "" for r in rows}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for order in map("".join, permutations("ABCDE")):
        for (i, _, part), fails in zip(rows, failing):
            part, gone = part or "", False
            for step, f in enumerate(order, 1):
                at = (part, order, step)
                hit = f in fails
                out[*at, "redundant"] += hit and gone
                out[*at, "unique_fails"] += fails == {f}
                if hit and not gone:
                    out[*at, "removed"] += 1
                    out[*at, "good_lost"] += i in good
                    out[*at, "toxic_lost"] += i in toxic
                    removed[part, f] += 1
                gone |= hit
                out[*at, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s): tuple(out[p, o, s, n] for n in names) + (removed[p, o[s - 1]],) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, part, "s", None) for i, t, part in rows], SHAPE).repartition(3)


def test_all_orders_by_simulation(spark):
    rng = random.Random(9)
    long = [prose(rng, 220, v) for v in (60, 900, 4000)]
    rows = []
    for i in range(80):
        t = rng.choice(long + [prose(rng, 30), "UPPER case #1", "same", "", None])
        rows.append((rng.choice([i, i, 3, None]), t + rng.choice(["", " $", " XYZ" * 40]) if t and rng.random() < 0.5 else t, rng.choice(["en", "fr", "", None])))
    rows += rows[:10]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 1), (None, 1, 1), (4, 1, 0), (4, 0, 1), (4, 1, 0)]
    got = found(interaction.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS)))
    assert got == simulated(rows, labels)


def test_edges(spark):
    no_labels = spark.createDataFrame([], LABELS)
    assert interaction.audit(empty_docs(spark), no_labels).collect() == []
    rows = [(i, t, "en") for i, t, *_ in edge_rows()]
    extra = {c: F.lit("x") for c in ("digest", "E", "total", "good", "joint", "own", "before", "first")}
    labels = spark.createDataFrame([(4, 1, 1)], LABELS).withColumns({"text": F.lit("x"), "n": F.lit(1), "E": F.lit(1)})
    assert found(interaction.audit(edge_docs(spark).withColumns(extra), labels)) == simulated(rows, [(4, 1, 1)])


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8) for _ in range(i + 1)], "part string, X boolean, Y boolean, Z boolean")
    joint = interaction.joint_failures(rows, "XYZ", "part", {"total": F.lit(1)})
    assert list(joint.first().total) == [sum(i + 1 for i in range(8) if i & s == s) for s in range(8)]
    out = interaction.interactions(joint, "XYZ", "part", []).collect()
    assert len(out) == 18
    removed = Counter()
    for r in out:
        removed[r.filter_order[r.step - 1]] += r.removed
        assert r.kept + r.removed + r.redundant <= 36
    assert all(r.shapley == removed[r.filter_order[r.step - 1]] for r in out)
    assert sum({r.filter_order[r.step - 1]: r.shapley for r in out}.values()) == 6 * 35


def test_query_over_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    assert found(op13_filter_interaction_audit(spark, SMALL)) == simulated([(r.doc_id, r.text, r.lang) for r in table], labels)
