import hashlib
import random
import zlib

import numpy as np

from tests.conftest import SMALL
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, words
from tidemark.llm import runs
from tidemark.llm.queries import op12_periodic_runs


def brute(w, length=6, power=4):
    """(start, length, period) of all maximal runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(length, power * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((start, size, q) for (start, size), q in found.items())


def collapsed(w, found):
    gone = {i for start, size, q in found for i in range(start + q, start + size)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def check(spark, texts, length=6, power=4, **more):
    out = runs.periodic_runs(docs(spark, list(enumerate(texts))), least_length=length, least_power=power, **more).collect()
    assert len(out) == len(texts)
    for r in out:
        w = words(texts[r.doc_id])
        want = brute(w, length, power)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, collapsed(w, want))


def periodic_texts(rng, n):
    for _ in range(n):
        letters = [f"w{i}é" for i in range(rng.choice([1, 2, 3, 8]))]
        w = rng.choices(letters, k=rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            at, period = rng.randint(0, len(w)), rng.choices(letters, k=rng.randint(1, 7))
            w[at:at] = period * rng.randint(2, 8) + period[: rng.randint(0, len(period))]
        yield rng.choice([" ", "\n", " \t "]).join(w)


def test_runs_by_brute_force(spark):
    check(spark, list(periodic_texts(random.Random(1), 400)))


def test_other_thresholds_and_small_blocks(spark):
    texts = list(periodic_texts(random.Random(2), 120))
    check(spark, texts, 2, 2)
    check(spark, texts, 9, 3, block=64)


def test_known_strings(spark):
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    texts = [" ".join(x) for x in (fibonacci[-1], thue, "a" * 700, "ab" * 300, "aab" * 100 + "b", "abcd" * 3, "abcd" * 4)]
    check(spark, texts)
    check(spark, texts, 2, 2)
    # a Fibonacci word holds powers over three but none of four, a Thue-Morse word none over two
    check(spark, [" ".join(fibonacci[-1])], 6, 3)
    assert runs.periodic_runs(docs(spark, [(1, texts[0]), (2, texts[1])])).selectExpr("sum(size(runs))").first()[0] == 0


def test_long_text_in_order_n_log_n(spark):
    rng = random.Random(4)
    w = [f"w{int(rng.random() ** 3 * 900)}" for _ in range(60_000)]
    w[20_000:44_000] = (w[20_000:26_000] * 4)[:24_000]
    out = runs.periodic_runs(docs(spark, [(1, " ".join(w))])).first()
    assert any((x.start, x.length, x.period) <= (20_000, x.length, 6_000) and x.length >= 24_000 and x.period == 6_000 for x in out.runs)
    tree = runs.SuffixTree(np.zeros(4096, np.int64), np.full(4096, 4096))
    assert len(tree.smaller_halves(2)[0]) <= 4096 * 13


def test_suffix_array_and_shared_words():
    rng = random.Random(6)
    for _ in range(50):
        strings = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(4)]
        word = np.array(sum(strings, []), np.int64)
        size = [len(s) for s in strings]
        end = np.repeat(np.cumsum(size), size)
        tree = runs.SuffixTree(word, end)
        suffix = lambda i: (end[i], word[i : end[i]].tolist())
        assert tree.order.tolist() == sorted(range(len(word)), key=suffix)
        for k in range(1, len(word)):
            (e, a), (f, b) = suffix(tree.order[k - 1]), suffix(tree.order[k])
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if e == f else 0
            assert tree.common[k] == same


def test_edge_rows(spark):
    rows = edge_rows() + [(20, "a\x1cb\x1fc \xa0"), (21, "go " * 30_000)]
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs(spark, rows)).collect())
    want = [(str(i), words(t)) for i, t, *_ in rows]
    small = [(i, w) for i, w in want if i != "21"]
    assert got == sorted([(i, brute(w), collapsed(w, brute(w))) for i, w in small] + [("21", [(0, 30_000, 1)], "go")])
    assert runs.periodic_runs(edge_docs(spark)).count() == len(edge_rows())
    assert runs.periodic_runs(empty_docs(spark)).collect() == []
    ids = docs(spark, [(1, "a " * 9)]).selectExpr("concat('id', doc_id) AS doc_id", "text")
    assert [(r.doc_id, r.collapsed) for r in runs.periodic_runs(ids).collect()] == [("id1", "a")]


def expected(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = min(((-size, start, q) for start, size, q in found), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    lines = "".join(f"{start},{size},{q}\n" for start, size, q in sorted(found, key=lambda x: (x[0], x[2])))
    return (doc_id, len(found), *best, sha(lines), sha(collapsed(w, found)))


def test_query_over_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        if len(t or "") < 30_000:
            assert got[i] == expected(i, t)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_query_over_texts_without_words(spark, tmp_path):
    rows = [(i, t) for i in range(40) for t in ("", " \t\n", None, "one", "go " * 9)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
