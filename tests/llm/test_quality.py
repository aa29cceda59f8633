import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, prose, quality_verdicts, quality_votes, words
from tidemark.llm import quality


def counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    n = len(w)
    return n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def check(rows, out):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((r[0], *counts(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in out)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 120), 12 if i % 3 else 500).replace(" w1 ", "\n")) for i in range(60)]
    rows += [(100, "a b c d e a b c d e a b c d e"), (101, "x\ny\nx\n\nx "), (102, "a a a a a a a"), (103, "1 2 3 4 5"), (104, "1 2 3 4")]
    check(rows, quality.judge(docs(spark, rows)).collect())


def test_edges(spark):
    check(edge_rows(), quality.judge(edge_docs(spark)).collect())
    assert quality.judge(empty_docs(spark)).collect() == []
    kept = quality.filter_documents(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert quality.filter_documents(empty_docs(spark)).collect() == []
    named = docs(spark, [(1, prose(random.Random(2), 60))]).withColumns({c: F.lit("own") for c in ("__q_text", "__q_n_words", "__q_quality")})
    assert quality.filter_documents(named).select("__q_text", "__q_n_words", "__q_quality").collect() == [("own", "own", "own")]


def test_posterior_separates_labelled_quality(spark):
    docs_, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs_).drop("quality").join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.1


def planted(n=4000):
    """Documents of which a tenth are bad as three rules see it; a fourth rule is noise."""
    rng, votes, good = random.Random(3), [], []
    for _ in range(n):
        fine = rng.random() < 0.9
        v = [1 if rng.random() < 0.99 else -1 for _ in quality.RULES]
        if not fine:
            v[1] = v[2] = v[3] = -1
        v[4] = -1 if rng.random() < 0.15 else 1
        votes.append(tuple(0 if rng.random() < 0.1 and j > 3 else x for j, x in enumerate(v)))
        good.append(fine)
    return votes, good


def brute_em(votes, start, rounds):
    """The same, one document and one rule at a time."""
    post = [list(start[v]) for v in votes]
    classes, rules = range(len(post[0])), range(len(votes[0]))
    for _ in range(rounds):
        share, rate = [], []
        for k in classes:
            share.append((sum(p[k] for p in post) + 1) / (len(votes) + len(classes)))
            rate.append([])
            for j in rules:
                bad = sum(p[k] for p, v in zip(post, votes) if v[j] == -1)
                voted = sum(p[k] for p, v in zip(post, votes) if v[j] != 0)
                rate[k].append((bad + 1) / (voted + 2))
        for p, v in zip(post, votes):
            for k in classes:
                p[k] = share[k]
                for j in rules:
                    p[k] *= rate[k][j] if v[j] == -1 else 1 - rate[k][j] if v[j] == 1 else 1
            total = sum(p)
            p[:] = [x / total for x in p]
    return share, rate, post


def test_em_equals_brute_force():
    votes, _ = planted(600)
    histogram = sorted(Counter(votes).items())
    start = dict(zip((v for v, _ in histogram), quality.start(histogram).tolist()))
    share, rate, post = brute_em(votes, start, 25)
    model, _ = quality.maximise(histogram, quality.start(histogram), 25, 0.0)
    np.testing.assert_allclose(model.share, share, rtol=1e-9)
    np.testing.assert_allclose(model.rate, rate, rtol=1e-9)
    known = dict(zip((v for v, _ in histogram), model.posterior(np.array([v for v, _ in histogram], float))[0]))
    for v, p in zip(votes, post):
        np.testing.assert_allclose(known[v], p, rtol=1e-6, atol=1e-12)


def test_em_decides_which_rules_to_believe():
    votes, good = planted()
    fitted = quality.fit(sorted(Counter(votes).items()))
    model = fitted["model"]
    assert abs(model.share[model.good] - 0.9) < 0.02
    post = model.posterior(np.array(votes, float))[0][:, model.good]
    assert sum((p > 0.5) == g for p, g in zip(post, good)) > 0.99 * len(votes)
    assert fitted["accuracy"][1] > 0.97 and fitted["accuracy"][4] < 0.85
    noise, agreed = [1] * 9, [1] * 9
    noise[4], agreed[1], agreed[2], agreed[3] = -1, -1, -1, -1
    kept = model.posterior(np.array([noise, agreed], float))[0][:, model.good]
    assert kept[0] > 0.9 and kept[1] < 0.1


def test_verdict_is_not_that_all_must_pass(spark):
    """Posteriors of the query are those of the mixture, and some document with a bad vote is kept."""
    table = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/documents.parquet")
    rows = quality.judge(table).collect()
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    assert len(texts) == len(rows)
    assert all(tuple(r[f"vote_{x}"] for x in quality.RULES) == quality_votes(texts[r.doc_id]) for r in rows)
    assert [r.kept for r in rows] == quality_verdicts([texts[r.doc_id] for r in rows])
    names = [f"vote_{r}" for r in quality.RULES]
    votes = [tuple(r[x] for x in names) for r in rows]
    model = quality.fit(sorted(Counter(votes).items()))["model"]
    want = model.posterior(np.array(votes, float))[0][:, model.good]
    np.testing.assert_allclose([r.quality for r in rows], want, rtol=1e-6, atol=1e-12)
    assert all(r.kept == (not r.base_failed and w >= 0.5) for r, w in zip(rows, want))
    assert any(r.kept and min(v) < 0 for r, v in zip(rows, votes))


def test_main_path_has_no_python(spark):
    plan = quality.judge(edge_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
