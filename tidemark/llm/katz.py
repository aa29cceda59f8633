"""Language-model scoring with a Katz backoff bigram model.

P(w | v) = d(c) c(v, w) / c(v) where the pair was seen c times, else alpha(v) P(w); P(w) is Good-Turing
discounted too, what it frees being the probability of an unknown word. alpha(v) is what the discounts
of v free, over what the words not seen after v have in P: every distribution sums to one exactly.
Discounts are Katz's Good-Turing ones, d(r) for r <= CUTOFF, from counts of counts (`discounts`).

Counting works on blocks of documents, which the reading tasks make as they go. A block sends each word
(with its count in the block) to the word's bucket and gets back the word's number and count in the
corpus. It then sends each distinct pair, with its count and the documents it stands in, to the bucket
of its first word. Buckets hold the n-gram tables: written tables, a packed row for each bucket. A
bucket has all pairs of a first word, so it has c(v) and alpha(v) at hand; pairs whose first word makes
up a large part of the corpus are dealt by both words, and its sums are merged (there are HOT of these
words per bucket at most, whatever the corpus). From its pairs each bucket sums log probabilities per
block and document, and the sums of a block's buckets meet in the block. Everything crosses the network
as packed arrays, once per distinct word or pair of a block, so no frequent word or pair makes a task
large. A bucket has the words or pairs of BUCKET_BYTES of text at most (there are never fewer buckets than
spark.sql.shuffle.partitions), each is a partition of its own, and a row of a table never holds more than one.

Defined cases: a null text is an empty one, which is the end token alone. A null doc_id hashes as the empty
text. Repeated rows are documents of their own. An empty table gives an empty result, and a table without
training rows a model that gives every token probability one. Other columns are not read. A very long text
is a block of its own. There may be 2^32 - 1 distinct words.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, materialize, shuffle_width, text_bytes

CUTOFF = 5
BLOCK_TOKENS = 2_000_000
BUCKET_BYTES = 32 << 20
HOT = 4
_END = b"\n"
_BEGIN = (1 << 32) - 1


def _dump(**arrays) -> bytes:
    """Arrays by name, each compressed with its bytes of one significance together."""
    import numpy as np
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    out = {}
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if a.dtype == np.uint64 and (not len(a) or a.max() < 1 << 32):
            a = a.astype(np.uint32)
        out[name] = (a.dtype.str, len(a), press(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b"")
    return pickle.dumps(out, protocol=5)


def _load(data: bytes) -> dict:
    import numpy as np
    import zstandard

    unpress, out = zstandard.ZstdDecompressor().decompress, {}
    for name, (kind, n, packed) in pickle.loads(data).items():
        kind = np.dtype(kind)
        raw = np.frombuffer(unpress(packed), np.uint8) if n else np.zeros(0, np.uint8)
        out[name] = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()
    return out


class _Numbers(dict):
    """Numbers things in the order of their first appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _batch(columns: dict):
    import pyarrow as pa

    kinds = {"payload": pa.binary(), "kind": pa.int32(), "stats": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def _blocks(batches: Iterator, buckets: int) -> Iterator:
    """Documents to blocks: a state row each (kind 0), and a row of words for each bucket (kind 1)."""
    import numpy as np
    import zstandard
    from pyspark import TaskContext

    task, n_block = TaskContext.get().partitionId(), 0

    def flush():
        nonlocal n_block
        block, n_block = task << 24 | n_block, n_block + 1
        words = list(vocabulary)
        lens, held = np.array([len(x) for x in tokens]), np.array(is_held, bool)
        tok = np.concatenate(tokens)
        count = np.bincount(tok[np.repeat(~held, lens)], minlength=len(words))
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(0, -1, block, _dump(tok=tok, lens=lens.astype(np.uint32), held=held, ids=np.array([i or 0 for i in ids], np.int64), null=np.array([i is None for i in ids]), bucket=bucket.astype(np.uint32)))]
        for b in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[b] : cuts[b + 1]]
            packed = zstandard.ZstdCompressor(level=1).compress(b" ".join(words[i] for i in own))
            rows.append((1, int(b), block, pickle.dumps((packed, _dump(n=count[own].astype(np.uint64))), protocol=5)))
        return _batch(dict(zip(("kind", "bucket", "block", "payload"), zip(*rows))))

    vocabulary, tokens, ids, is_held, size = _Numbers({_END: 0}), [], [], [], 0
    for b in batches:
        for i, text, held in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), b.column("held").to_pylist()):
            own = text.lower().split()
            own.append(_END)
            tokens.append(np.fromiter(map(vocabulary.__getitem__, own), np.uint32, len(own)))
            ids.append(i)
            is_held.append(held)
            size += len(own)
            if size >= BLOCK_TOKENS:
                yield flush()
                vocabulary, tokens, ids, is_held, size = _Numbers({_END: 0}), [], [], [], 0
    if tokens:
        yield flush()


def _count_words(table, buckets: int):
    """All rows of a word bucket: number and corpus count of each word, for each block; and counts of counts."""
    import numpy as np
    import zstandard

    numbers, each = _Numbers(), []
    for block, payload in sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist())):
        packed, counts = pickle.loads(payload)
        words = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
        each.append((block, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), _load(counts)["n"]))
    total = np.zeros(len(numbers), np.uint64)
    for _, own, n in each:
        total[own] += n
    bucket = table.column("bucket")[0].as_py()
    rows = [(bucket, block, _dump(id=(own * buckets + bucket).astype(np.uint64), c=total[own]), None) for block, own, _ in each]
    rows.append((bucket, -1, None, _tally(total)))
    import pyarrow as pa

    return pa.Table.from_batches([_batch(dict(zip(("bucket", "block", "payload", "stats"), zip(*rows))))])


def _tally(counts) -> list[float]:
    """Tokens, types, and types of each count from 1 to CUTOFF + 1."""
    import numpy as np

    return [float(counts.sum()), float((counts > 0).sum()), *(float((counts == r).sum()) for r in range(1, CUTOFF + 2))]


def discounts(of_counts: list[float]) -> list[float]:
    """d(1) .. d(CUTOFF) from the number of types of counts 1 .. CUTOFF + 1.

    Katz's formula up to the largest cutoff at which every discount lies between 0 and 1; counts above it
    are not discounted. Where no cutoff fits (few texts), half a count is taken off each."""
    n = of_counts
    for k in range(CUTOFF, 1, -1):
        if min(n[: k + 1]) <= 0 or (over := (k + 1) * n[k] / n[0]) >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - over) / (1 - over) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d + [1.0] * (CUTOFF - k)
    return [(r - 0.5) / r for r in range(1, CUTOFF + 1)]


class Unigram:
    """P(w) from the count of w; count 0 is the unknown word."""

    def __init__(self, stats: list[float]) -> None:
        import numpy as np

        self.n, self.types = stats[0], stats[1]
        d = discounts(stats[2:])
        freed = sum((1 - d[r - 1]) * r * stats[1 + r] for r in range(1, CUTOFF + 1))
        self.d = np.array([0.0, *d, 1.0])
        self.below = self.n if freed > 0 else self.n + 1
        self.unknown = freed / self.n if freed > 0 else 1 / (self.n + 1)

    def p(self, c):
        import numpy as np

        seen = self.d[np.minimum(c, CUTOFF + 1).astype(np.int64)] * c / max(self.below, 1)
        return np.where(c > 0, seen, self.unknown)


def _send_pairs(table, buckets: int, n: float, types: float):
    """All rows of a block: its pairs to their buckets, and what is known of its documents."""
    import numpy as np
    import pyarrow as pa

    state, answers = None, []
    for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
        if bucket < 0:
            state = _load(payload)
        else:
            answers.append((bucket, _load(payload)))
    block = table.column("block")[0].as_py()
    answers.sort(key=lambda x: x[0])
    order = np.argsort(state["bucket"], kind="stable")
    number, count = np.zeros(len(order), np.uint64), np.zeros(len(order), np.uint64)
    number[order] = np.concatenate([a["id"] for _, a in answers])
    count[order] = np.concatenate([a["c"] for _, a in answers])
    tok, lens, held = state["tok"], state["lens"].astype(np.int64), state["held"]
    starts = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)
    c = count[tok]
    known = np.add.reduceat((c > 0).astype(np.int64), starts)
    base = np.add.reduceat(np.log10((c + 0.1) / (n + 0.1 * (types + 1))), starts)
    rows = [(-1 - block, block, _dump(ids=state["ids"], null=state["null"], held=held, n=lens, known=known, base=base))]
    w = number[tok]
    if number.max() >= _BEGIN:
        raise OverflowError("more than 2^32 - 1 distinct words")
    v = np.r_[np.uint64(_BEGIN), w[:-1]]
    v[starts] = _BEGIN
    of_v = np.r_[count[0], c[:-1]]
    of_v[starts] = count[0]  # texts begin as often as they end
    key, first, inverse, often = np.unique(v << np.uint64(32) | w, return_index=True, return_inverse=True, return_counts=True)
    trained = np.bincount(inverse, weights=np.repeat(~held, lens), minlength=len(key)).astype(np.uint64)
    hot = of_v[first].astype(float) * HOT * buckets > n
    mixed = np.where(hot, key, key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    docs = doc[np.argsort(inverse, kind="stable")]
    ends = np.cumsum(often)
    for b in np.flatnonzero(np.diff(cuts)):
        own = by[cuts[b] : cuts[b + 1]]
        at = np.repeat(ends[own] - often[own], often[own])
        at += np.arange(len(at)) - np.repeat(np.cumsum(often[own]) - often[own], often[own])
        k = key[own]
        a = k >> np.uint64(32)
        rows.append((int(b), block, _dump(
            v=np.diff(a, prepend=np.uint64(0)), w=k & np.uint64(_BEGIN), n=trained[own], c=c[first[own]], hot=hot[own],
            often=often[own].astype(np.uint64), doc=docs[at].astype(np.uint32),
        )))
    return pa.Table.from_batches([_batch(dict(zip(("bucket", "block", "payload"), zip(*rows))))])


def _merge_pairs(table, unigram: Unigram):
    """All rows of a pair bucket: its part of the bigram table, with who holds which pair (kind 1), counts of
    counts (kind 3) and its share of the sums of hot first words (kind 2). Rows on documents pass (kind 0)."""
    import numpy as np
    import pyarrow as pa

    bucket = table.column("bucket")[0].as_py()
    names = ("kind", "bucket", "block", "payload", "stats")
    came = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
    if bucket < 0:
        return pa.Table.from_batches([_batch(dict(zip(names, zip(*[(0, bucket, b, p, None) for b, p in came]))))])
    blocks, keys, counts, words, hots, often, docs = [], [], [], [], [], [], []
    for block, payload in came:
        x = _load(payload)
        keys.append(np.cumsum(x["v"].astype(np.uint64)) << np.uint64(32) | x["w"].astype(np.uint64))
        blocks.append(block)
        counts.append(x["n"].astype(np.float64))
        words.append(x["c"])
        hots.append(x["hot"])
        often.append(x["often"].astype(np.uint32))
        docs.append(x["doc"])
    sizes = np.array([len(k) for k in keys])
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key))
    c, hot = np.zeros(len(key), np.uint64), np.zeros(len(key), bool)
    c[inverse], hot[inverse] = np.concatenate(words), np.concatenate(hots)
    # positions in the table rise within a block: their steps are small
    steps = np.concatenate([np.diff(i, prepend=0) for i in np.split(inverse, np.cumsum(sizes)[:-1])]).astype(np.uint32)
    packed = _dump(
        key=np.diff(key, prepend=np.uint64(0)), n=n.astype(np.uint64), c=c, hot=hot, step=steps, often=np.concatenate(often),
        doc=np.concatenate(docs), blocks=np.array(blocks, np.int64), pairs=sizes.astype(np.uint32), held=np.array([len(d) for d in docs], np.uint32),
    )
    rows = [(1, bucket, -1, packed, None), (3, bucket, -1, None, _tally(n))]
    if hot.any():
        v, first = np.unique(key[hot] >> np.uint64(32), return_index=True)
        seen = n[hot]
        parts = [seen, np.where(seen > 0, unigram.p(c[hot].astype(float)), 0.0), *(np.where(seen == r, 1.0, 0.0) for r in range(1, CUTOFF + 1))]
        sums = np.stack([np.add.reduceat(p, first) for p in parts], 1)
        rows += [(2, int(x), -1, None, s.tolist()) for x, s in zip(v, sums)]
    return pa.Table.from_batches([_batch(dict(zip(names, zip(*rows))))])


def pair_logs(key, n, c, d, unigram: Unigram, hot: dict[int, list[float]]):
    """log10 P(w | v) of each pair; key sorted, n: times seen in training, c: count of w, d: discounts.
    hot: sums of first words that are not complete here: [times, P of seen words, pairs seen 1 .. CUTOFF times]."""
    import numpy as np

    if not len(key):
        return np.zeros(0)
    d = np.array([0.0, *d, 1.0])
    v = key >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    run = np.cumsum(np.r_[False, v[1:] != v[:-1]])
    kept = d[np.minimum(n, CUTOFF + 1).astype(np.int64)] * n
    p = unigram.p(c)
    times, seen_p, freed = (np.add.reduceat(x, first) for x in (n, np.where(n > 0, p, 0.0), n - kept))
    for i, x in enumerate(v[first].tolist()):
        if x in hot:
            s = hot[x]
            times[i], seen_p[i], freed[i] = s[0], s[1], sum((1 - d[r]) * r * s[1 + r] for r in range(1, CUTOFF + 1))
    below = np.where(freed > 0, times, times + 1)  # without discounts, one count more is set aside
    left = np.where(times > 0, np.where(freed > 0, freed, 1.0) / below, 1.0)
    alpha = left / np.where(times > 0, np.maximum(1 - seen_p, unigram.unknown), 1.0)
    return np.log10(np.where(n > 0, kept / below[run], alpha[run] * p))


def _score_pairs(batches: Iterator, d: list[float], unigram: Unigram, hot: dict[int, list[float]]) -> Iterator:
    import numpy as np

    for b in batches:
        for bucket, payload in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist()):
            x = _load(payload)
            key = np.cumsum(x["key"].astype(np.uint64))
            logs = pair_logs(key, x["n"].astype(float), x["c"].astype(float), d, unigram, hot)
            rows, i, j = [], 0, 0
            for block, pairs, held in zip(x["blocks"].tolist(), x["pairs"].tolist(), x["held"].tolist()):
                at = np.cumsum(x["step"][i : i + pairs].astype(np.int64))
                doc = x["doc"][j : j + held]
                sums = np.bincount(doc, weights=np.repeat(logs[at], x["often"][i : i + pairs]))
                own = np.unique(doc)
                rows.append((bucket, block, _dump(doc=own, sum=sums[own])))
                i, j = i + pairs, j + held
            yield _batch(dict(zip(("bucket", "block", "payload"), zip(*rows))))


def _finish(table, n: float):
    import numpy as np
    import pyarrow as pa

    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()))
    x = _load(rows[0][1])
    score = np.zeros(len(x["n"]))
    for _, payload in rows[1:]:
        s = _load(payload)
        score[s["doc"]] += s["sum"]
    return pa.table({
        "doc_id": pa.array(x["ids"], mask=x["null"]), "held_out": pa.array(x["held"]), "n_tokens": pa.array(x["n"]), "n_known": pa.array(x["known"]),
        "train_tokens": pa.array(np.full(len(score), int(n), np.int64)), "base_score": pa.array(x["base"]), "score": pa.array(score),
    })


def _places(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket a number that Spark's hash puts into a partition of its own among as many, so that no two buckets
    meet in one and leave another empty."""
    found = spark.range(64 * buckets).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    by = {r["p"]: r["id"] for r in found}  # a row for each bucket
    return [by.get(p, p) for p in range(buckets)]


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model
    learns from those for which the boolean column held_out is false."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-size // BUCKET_BYTES))
    held = F.lit(_places(docs.sparkSession, buckets))

    def dealt(df: DataFrame):
        place = F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.element_at(held, F.col("bucket").cast("int") + 1))
        return df.withColumn("place", place).repartition(buckets, "place").groupBy("place", "bucket")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    sent = materialize(rows.mapInArrow(lambda it: _blocks(it, buckets), "kind int, bucket long, block long, payload binary"), "blocks", "kind")
    words = dealt(sent.filter("kind = 1").select("bucket", "block", "payload"))
    counted = materialize(words.applyInArrow(lambda t: _count_words(t, buckets), "bucket long, block long, payload binary, stats array<double>"), "unigrams")
    width = CUTOFF + 3
    stats = _sums(counted.filter("block < 0"), width)
    unigram, n, types = Unigram(stats), stats[0], stats[1]
    met = sent.filter("kind = 0").select("bucket", "block", "payload").union(counted.filter("block >= 0").select("bucket", "block", "payload"))
    pairs = met.groupBy("block").applyInArrow(lambda t: _send_pairs(t, buckets, n, types), "bucket long, block long, payload binary")
    merged = materialize(dealt(pairs).applyInArrow(lambda t: _merge_pairs(t, unigram), "kind int, bucket long, block long, payload binary, stats array<double>"), "bigrams", "kind")
    drop(sent, counted)
    d = discounts(_sums(merged.filter("kind = 3"), width)[2:])
    parts = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(2 + CUTOFF)]
    hot = {r[0]: list(r[1:]) for r in merged.filter("kind = 2").groupBy("bucket").agg(*parts).collect()}  # HOT * buckets at most
    summed = merged.filter("kind = 1").select("bucket", "payload").mapInArrow(lambda it: _score_pairs(it, d, unigram, hot), "bucket long, block long, payload binary")
    both = merged.filter("kind = 0").select("bucket", "block", "payload").union(summed)
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("block").applyInArrow(lambda t: _finish(t, n), shape)


def _sums(df: DataFrame, width: int) -> list[float]:
    return [x or 0.0 for x in df.agg(*[F.sum(F.col("stats")[i]) for i in range(width)]).first()]
