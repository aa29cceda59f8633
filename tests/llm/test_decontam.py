import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SMALL
from tests.llm.helpers import docs, edge_docs, empty_docs, prose
from tidemark.llm import decontam

ITEMS = "item_id long, text string"


def brute_distance(pattern, text):
    """Least edits of the pattern against any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abcd", max_size=150))
def test_myers_equals_the_table(pattern, text):
    want, got = brute_distance(pattern, text), decontam.myers(decontam._bits(pattern), len(pattern), text, len(pattern))
    assert (got[0] if got else len(pattern)) == min(want, len(pattern))


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "z", "é", text[i] + "q"]) + text[i + 1 :]
    return text


def test_matches_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(3, 40), 60)) for i in range(12)] + [(50, "tiny"), (51, "two words"), (52, None), (53, "  "), (1, None)]
    rows = []
    for i in range(60):
        text = prose(rng, 30, 60)
        if i % 2:
            text += " " + edited(rng, items[i % 12][1], rng.randrange(0, 6)).replace(" ", rng.choice([" ", "\n", "  "])) + " " + prose(rng, 20, 60)
        rows.append((i, text.upper() if i % 5 == 0 else text))
    rows += [(100, "x tiny y"), (101, "é" * 40 + "two words" + "ß" * 20)]
    check_matches(spark, items, rows, 20)


def check_matches(spark, items, rows, least):
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for i, t in items:
        if not t or not t.strip():
            continue
        x = decontam.Item(i, decontam.normal(t), decontam.RATE)
        for d, text in rows:
            if (k := brute_distance(x.text, decontam.normal(text))) <= x.budget:
                want[d, i] = k
    assert found == want and len(want) > least


def test_periodic_texts_give_the_least_distance(spark):
    rng = random.Random(16)
    items, rows = [], []
    for i in range(24):
        unit = prose(rng, rng.randrange(1, 4), 9) + " "
        items.append((i, (unit * 20)[: rng.randrange(30, 120)]))
        for n in range(4):
            rows.append((4 * i + n, edited(rng, unit * rng.randrange(4, 30), rng.randrange(1, 12)) + prose(rng, 5)))
    check_matches(spark, items, rows, 60)


def test_short_items_have_the_same_budget(spark):
    rng = random.Random(17)
    items = [(m, "".join(rng.choice("abcdé ") for _ in range(m))) for m in range(1, 45)]
    rows = [(n, prose(rng, 4) + edited(rng, rng.choice(items)[1] + "  ", rng.randrange(0, 4)) + prose(rng, 4)) for n in range(200)]
    check_matches(spark, items, rows, 200)


def test_an_occurrence_lies_in_one_document(spark):
    rows, items = [(1, "xx abcd"), (2, "efghi yy"), (3, "abcd\0efghi")], [(1, "abcd\0efghi"), (2, "bcd\0")]
    finder = decontam.Finder(items, 0.0)
    assert [[x[0] for x in found] for found in finder.search([r[1] for r in rows])] == [[], [], [1, 2]]


def test_leaks_of_the_benchmark(spark):
    """Every item inserted with a few edits is found; the clean text around it is not."""
    rng = random.Random(8)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rows, planted = [], set()
    for n, (i, t) in enumerate(items.items()):
        rows.append((2 * n, prose(rng, 50) + " " + edited(rng, t, len(t) // 25) + " " + prose(rng, 50)))
        rows.append((2 * n + 1, prose(rng, 100)))
        planted.add((2 * n, i))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, rows), bench).collect()}
    assert planted <= got and all(d % 2 == 0 for d, _ in got)
    kept = decontam.decontaminate(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if r[0] % 2]


def test_blocks_of_items(spark, monkeypatch):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = sorted(map(tuple, decontam.matches(table, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, decontam.matches(table, bench).collect())) == whole
    kept = {r.doc_id for r in decontam.decontaminate(table, bench).collect()}
    assert kept == {r.doc_id for r in table.select("doc_id").collect()} - {r[0] for r in whole}


def test_edges(spark):
    items = spark.createDataFrame([(1, "no such passage anywhere in here"), (1, "no such passage anywhere in here")], ITEMS)
    assert decontam.matches(edge_docs(spark), items).collect() == []
    kept = decontam.decontaminate(edge_docs(spark), items)
    assert kept.columns == edge_docs(spark).columns and kept.count() == edge_docs(spark).count()
    assert decontam.matches(empty_docs(spark), items).collect() == []
    assert decontam.matches(edge_docs(spark), items.limit(0)).collect() == []
