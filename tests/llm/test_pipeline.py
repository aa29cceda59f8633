from collections import Counter

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.helpers import edge_docs, empty_docs, quality_verdicts, words
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tidemark.llm import decontam

DATA = SMALL.replace("0.001", "0.01")


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, step = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        step[name] = docs
        assert docs.columns == columns or name == "sharding"
    rows = {n: d.collect() for n, d in step.items()}
    start = spark.read.parquet(f"{DATA}/documents.parquet").collect()

    verdicts = quality_verdicts([r.text for r in start])
    assert Counter(rows["quality rules"]) == Counter(r for r, kept in zip(start, verdicts) if kept)

    kept = rows["quality rules"]
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in kept]
    least = brute_components(fps)
    assert sorted(r.doc_id for r in rows["simhash near-dedup"]) == sorted(set(least.values()))

    items = [decontam.Item(r.item_id, decontam.normal(r.text), decontam.RATE) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in rows["simhash near-dedup"] if any(x.text in decontam.normal(r.text) for x in items)}
    clean = {r.doc_id for r in rows["benchmark decontamination"]}
    assert not exact & clean and len(clean) + len(exact) >= len(rows["simhash near-dedup"]) - 2

    mixed = Counter(r.doc_id for r in rows["mixing to target weights"])
    assert max(mixed.values()) <= 3 and set(mixed) <= clean
    size = {r.doc_id: len(words(r.text)) for r in rows["benchmark decontamination"]}
    assert abs(sum(size[i] * n for i, n in mixed.items()) - sum(size.values())) < 0.02 * sum(size.values())
    assert Counter(r.doc_id for r in rows["sharding"]) == mixed


def test_run_and_edges(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    docs = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test")
    assert "shard" in docs.columns


def test_an_empty_table_passes_every_stage(spark):
    docs = empty_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test")
        assert docs.collect() == [] and (docs.columns == empty_docs(spark).columns or name == "sharding")


def test_repeated_rows_and_ties_pass_every_stage(spark):
    """Equal rows are one after the second stage, and what comes out does not depend on how the table is cut."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    twice = table.union(table).union(table.limit(20))
    outs = []
    for docs in (table, twice.repartition(5)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test")
        outs.append(Counter(docs.collect()))
    assert max(outs[1].values()) == 1 and len(outs[1]) > 100 and len(outs[0] - outs[1]) + len(outs[1] - outs[0]) < 10
