import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import events, metrics, ranges, windows


@pytest.fixture(params=[1_000_000, 7])
def rows_a_range(request, monkeypatch):
    """One range for all rows, or many small ones: nothing changes."""
    monkeypatch.setattr(ranges, "ROWS", request.param)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("current", [False, True])
def test_running_sums(spark, rows_a_range, descending, current):
    rng = random.Random(1)
    rows = [(float(k), rng.randrange(9)) for k in rng.sample(range(10_000), 120)]
    out = ranges.cumulative(spark.createDataFrame(rows, "k double, n long").repartition(3), "k", {"run": F.col("n")}, descending, current).collect()
    total, want = 0, {}
    for k, n in sorted(rows, reverse=descending):
        want[k] = total + n * current
        total += n
    assert {r.k: r.run for r in out} == want and len(out) == len(rows)


def test_running_sums_of_groups(spark, rows_a_range):
    rng = random.Random(2)
    rows = [(g, k, rng.randrange(9)) for g in "ab" for k in rng.sample(range(1000), 40)]
    out = ranges.cumulative(spark.createDataFrame(rows, "g string, k int, n long"), "k", {"run": F.col("n")}, by=["g"]).collect()
    assert all(r.run == sum(n for g, k, n in rows if g == r.g and k <= r.k) for r in out) and len(out) == 80


def test_positions_of_texts(spark, rows_a_range):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("aéz0 ") for _ in range(rng.randrange(0, 12))) for _ in range(150)}, key=str.encode)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    out = ranges.positions(df, "t", ranges.text_key(F.col("t"))).collect()
    assert {r.t: r.position for r in out} == {t: i for i, t in enumerate(texts)}


def test_rank_metrics_by_ranges(spark, rows_a_range):
    rng = random.Random(4)
    rows = [(i, rng.randrange(60) / 7, rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s double, y boolean").repartition(3)
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df, "s", F.col("y")).first().auc - area) < 1e-12
    ranked = {r.s: r.avg_rank for r in windows.average_ranks(df, "s").collect()}
    assert ranked == {s: sum(b < s for _, b, _ in rows) + (sum(b == s for _, b, _ in rows) + 1) / 2 for s in {s for _, s, _ in rows}}
    ap = sum(sum(b >= a for b in pos) / sum(b >= a for _, b, _ in rows) for a in pos) / len(pos)
    assert abs(metrics.average_precision(df, "s", F.col("y")).first().average_precision - ap) < 1e-12
    p = {r.i: r.p_value for r in metrics.conformal_p(df.filter("NOT y"), df, "s", "i").collect()}
    assert all(abs(p[i] - (1 + sum(b >= s for b in neg)) / (len(neg) + 1)) < 1e-12 for i, s, _ in rows)
    pairs = [(a, b) for _, a, _ in rows for _, b, _ in rows if a > b]
    assert metrics.concordance(df, "s", "s").first().concordant == len(pairs)
    top = metrics.upper_rank(df, "s", 20).first()
    assert top.threshold == sorted((s for _, s, _ in rows), reverse=True)[(300 + 1) // 20 - 1]


def test_event_numbers_by_ranges(spark, rows_a_range):
    rng = random.Random(5)
    rows = [(f"seq{rng.randrange(10**6)}", k) for _ in range(40) for k in range(1, rng.randrange(2, 5))]
    rows = sorted(set(rows))
    out = events.numbered(spark.createDataFrame(rows, "sequence_id string, island long").repartition(3)).collect()
    assert [(r.sequence_id, r.island) for r in sorted(out, key=lambda r: r.event_id)] == rows
    assert sorted(r.event_id for r in out) == [f"ev_{i:06d}" for i in range(len(rows))]
