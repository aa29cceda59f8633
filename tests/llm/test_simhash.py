import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, prose, words
from tidemark.llm import simhash


def brute_fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes):
    """nodes: (doc_id, fingerprint). doc_id -> least id reachable, by search over all pairs."""
    out, left = {}, set(range(len(nodes)))
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            i = todo.pop()
            for j in [j for j in left if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 3]:
                left.discard(j)
                group.add(j)
                todo.append(j)
        least = min((nodes[i][0] for i in group if nodes[i][0] is not None), default=None)
        out |= {i: least for i in group}
    return out


def near_rows(seed=2, n=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = prose(rng, rng.choice([2, 8, 200, 900]), 5000)
        rows.append((len(rows), text))
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = text.split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [near_rows(), edge_rows()], ids=["near", "edges"])
def test_components_equal_brute_force(spark, rows):
    df = edge_docs(spark) if rows[0][1] is None else docs(spark, rows)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components_of(df).collect()), key=str)
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    least = brute_components(fps)
    assert got == sorted(((d, f"{fp:016x}", least[i]) for i, (d, fp) in enumerate(fps)), key=str)


@pytest.mark.parametrize("wide", [1 << 18, 50])
def test_chains_and_long_postings(spark, monkeypatch, wide):
    """Fingerprints planted at chosen distances: chains of three-bit steps, and a posting of all of them."""
    monkeypatch.setattr(simhash, "LONG", 100)
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng, base, fps = random.Random(4), 0x0123456789ABCDEF, set()
    for _ in range(12):
        x = base ^ rng.getrandbits(40)
        for _ in range(40):
            fps.add(x)
            for b in rng.sample(range(40), rng.choice([1, 3, 4])):
                x ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    least = brute_components([(s, f) for s, f in zip(signed, fps)])
    assert [roots.get(s, s) for s in signed] == [least[i] for i in range(len(fps))]


def test_many_fingerprints_that_differ_in_few_bytes(spark, monkeypatch):
    """They are looked up with bits changed, which finds the links that comparing all pairs finds."""
    rng = random.Random(6)
    fps = sorted({rng.getrandbits(14) | 0xAB << 40 for _ in range(700)})
    out = []
    for long in (4096, 20):
        monkeypatch.setattr(simhash, "LONG", long)
        forest = simhash.Forest(len(fps))
        simhash._along(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), forest, np.arange(len(fps)))
        out.append(forest.root.tolist())
    least = brute_components(list(enumerate(fps)))
    assert out[0] == out[1] == [least[i] for i in range(len(fps))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=5)), min_size=1, max_size=20))
def test_the_filter_keeps_every_link(pairs):
    """Pairs at most three bits apart share five bytes or more, so that the tally drops none."""
    a = [x for x, _ in pairs]
    b = [x ^ sum(1 << k for k in set(bits)) for x, bits in pairs]
    got = simhash._linked(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [(x ^ y).bit_count() <= 3 for x, y in zip(a, b)]


def test_a_posting_gives_a_forest(spark):
    """A thousand fingerprints that all link: links stay in proportion to rows."""
    rows = spark.createDataFrame([(i,) for i in range(8)] + [(1 << 20 | i,) for i in range(8)] + [(i << 8 | j,) for i in range(30) for j in range(30)], "fp long").distinct()
    n = rows.count()
    assert simhash.links(rows).count() <= len(simhash.TRIPLES) * n


def test_deduplicate(spark):
    df = edge_docs(spark)
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    texts = [r.text for r in out.collect()]
    groups = set(brute_components([(i, brute_fingerprint(r[1])) for i, r in enumerate(edge_rows())]).values())
    assert len(texts) == len(groups)
    assert simhash.deduplicate(empty_docs(spark)).collect() == []
    assert simhash.components_of(empty_docs(spark)).collect() == []
