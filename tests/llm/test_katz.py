import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, prose, words
from tidemark.llm import katz
from tidemark.llm.queries import op3_katz_backoff


def held_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Brute:
    """The model by dictionaries, one token at a time."""

    def __init__(self, rows):
        self.tokens = [[w.lower() for w in words(t)] + [b"\n"] for _, t in rows]
        self.held = [is_held(i) for i, _ in rows]
        self.uni, self.after = Counter(), defaultdict(Counter)
        for t, h in zip(self.tokens, self.held):
            if not h:
                self.uni.update(t)
                for v, w in zip([None, *t], t):
                    self.after[v][w] += 1
        self.n, self.types = sum(self.uni.values()), len(self.uni)
        self.du = [0, *katz.discounts(self.of(self.uni.values())), 1]
        self.db = [0, *katz.discounts(self.of(c for s in self.after.values() for c in s.values())), 1]
        freed = sum((1 - self.du[min(c, 6)]) * c for c in self.uni.values())
        self.below, self.unknown = (self.n, freed / self.n if self.n else 0) if freed > 0 else (self.n + 1, 1 / (self.n + 1))
        self.cache = {}

    @staticmethod
    def of(counts):
        c = Counter(counts)
        return [float(c[r]) for r in range(1, 7)]

    def p1(self, w):
        c = self.uni.get(w, 0)
        return self.du[min(c, 6)] * c / self.below if c else self.unknown

    def p2(self, w, v):
        if v not in self.after:
            return self.p1(w)
        seen = self.after[v]
        if v not in self.cache:
            times = sum(seen.values())
            freed = sum((1 - self.db[min(c, 6)]) * c for c in seen.values())
            below = times if freed > 0 else times + 1
            self.cache[v] = below, (freed if freed > 0 else 1) / below / max(1 - sum(map(self.p1, seen)), self.unknown)
        below, alpha = self.cache[v]
        c = seen.get(w, 0)
        return self.db[min(c, 6)] * c / below if c else alpha * self.p1(w)

    def rows(self, ids):
        for i, t, h in zip(ids, self.tokens, self.held):
            base = sum(math.log10((self.uni.get(w, 0) + 0.1) / (self.n + 0.1 * (self.types + 1))) for w in t)
            score = sum(math.log10(self.p2(w, v)) for v, w in zip([None, *t], t))
            yield i, h, len(t), sum(w in self.uni for w in t), self.n, base, score


def check(rows, out):
    brute = Brute(rows)
    key = lambda r: (str(r[0]), r[2], r[5])
    want, got = sorted(brute.rows([r[0] for r in rows]), key=key), sorted(map(tuple, out), key=key)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    for w, g in zip(want, got):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)
    return brute


@pytest.mark.parametrize("block,hot,bucket", [(2_000_000, 4, 1 << 25), (300, 1, 1 << 25), (300, 4, 400)])
def test_scores_equal_brute_force(spark, monkeypatch, block, hot, bucket):
    """Many small blocks, first words that are dealt by both words, and many buckets change nothing."""
    monkeypatch.setattr(katz, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "HOT", hot)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 80), 90)) for i in range(150)]
    check(rows, katz.score(docs(spark, rows), held_column()).collect())


def test_distributions_sum_to_one():
    rng = random.Random(7)
    m = Brute([(i, prose(rng, 40, 60)) for i in range(200)])
    vocabulary = set(m.uni)
    for v in [None, *list(vocabulary)[:20], b"never seen"]:
        unknown = m.p2(b"never seen", v)
        assert sum(m.p2(w, v) for w in vocabulary) + unknown == pytest.approx(1)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(rows, katz.score(edge_docs(spark), held_column()).collect())
    assert katz.score(empty_docs(spark), held_column()).collect() == []
    only_held = [(i, "some words") for i in range(200) if is_held(i)]
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in katz.score(docs(spark, only_held), held_column()).collect())


def test_query_beats_the_base_on_held_out_text(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = op3_katz_backoff(spark, SMALL).collect()
    check(table, out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
