"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint of 64 bits is eight bytes. Two fingerprints that differ in three bits at most differ in
three bytes at most, so they agree in five byte positions or more: the guaranteed minimum of the
count filter. Of any five positions, three lie in the same half of the fingerprint; the inverted index
therefore has the positions three at a time, within each half, which makes eight postings for a
fingerprint, none of them long. Along a posting the shared positional bytes of each pair are tallied,
position by position, pairs below the minimum are dropped, and the rest alone are verified by their differing
bits. A posting that holds a large part of the corpus all the same (a sketch of frequent keys finds those) is
dealt by two more of its other five positions, of which a link shares two at least.

What is asked for is who is reachable from whom, so a posting gives a spanning forest of its links,
one row for each fingerprint at most, never all its pairs. Components come from alternating large-star
and small-star steps over tables in the shared folder.

Defined cases: null and blank texts have fingerprint zero and link like any other. Texts of fewer than
three words are one shingle. Equal texts have equal fingerprints and so one component. Null doc_ids are
passed over by the minimum; a component of null ids alone has a null id. Repeated rows stay in
`components_of` and are one row in `deduplicate`. An empty table gives an empty result. Other columns are
not read; `deduplicate` gives them back as they are. Very long texts are hashed whole; their shingles are
taken one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_columns, drop, hashable, materialize, text_bytes

SHINGLE = 3
SEED = 42
MAX_BITS = 3
LEAST_SHARED = 5
#: Positions of the bytes of a posting key: any five of eight hold one of these.
TRIPLES = tuple(tuple(half + k for k in range(4) if k != left_out) for half in (0, 4) for left_out in range(4))
#: Postings longer than this are looked up by two more positions before pairs are compared.
LONG = 4096
#: Postings of more fingerprints than this are dealt to several tasks.
WIDE = 1 << 18
#: Frequent keys that the sketch tracks: any key of over a 7,500th of all rows is among them.
TRACKED = 10_000


def fingerprint(text: bytes) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        shingles, n = [b" ".join(w)], 1
    else:
        shingles, n = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)))), len(w) - SHINGLE + 1
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(0, dtype=np.uint16)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        fp = np.array([fingerprint(t) for t in text_bytes(b.column("text"))], np.uint64).view(np.int64)
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(fp, pa.int64())], names=[*rest, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp (the fingerprint as a signed 64-bit number) in place of text."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(_fingerprints, ", ".join([*kinds, "fp long"]))


def _postings(fp: str) -> list:
    """Key of each posting: which triple, and the three bytes."""
    keys = []
    for k, triple in enumerate(TRIPLES):
        mask = sum(0xFF << (8 * p) for p in triple)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(signed))))
    return keys


class Forest:
    """Union-find over rows 0..n-1; merges take arrays of pairs."""

    def __init__(self, n: int) -> None:
        import numpy as np

        self.root = np.arange(n)

    def merge(self, a, b) -> None:
        import numpy as np

        while len(a):
            x, y = self.root[a], self.root[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.root, hi, lo)
            while (self.root != (up := self.root[self.root])).any():
                self.root = up
            left = self.root[a] != self.root[b]
            a, b = a[left], b[left]


def _linked(x, y):
    """Whether fingerprints link. The bytes that a pair shares are tallied over the positions first; only pairs with as
    many as any link has are verified by their bits."""
    import numpy as np

    a, b = np.broadcast_arrays(x, y)
    xs, ys = (np.ascontiguousarray(v).view(np.uint8).reshape(*v.shape, 8) for v in (x, y))
    shared = np.zeros(a.shape, np.uint8)
    for p in range(8):
        shared += xs[..., p] == ys[..., p]
    out = shared >= LEAST_SHARED
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= MAX_BITS
    return out


def _neighbours(fps, rows, forest: Forest) -> None:
    """Merge links of many fingerprints that differ in few bytes: each is looked up with up to MAX_BITS bits changed."""
    import numpy as np

    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [np.uint64(1 << k) for k in range(64) if differ >> k & 1]
    order = np.argsort(fps, kind="stable")
    held = fps[order]
    for n in range(1, MAX_BITS + 1):
        for chosen in itertools.combinations(bits, n):
            near = held ^ np.bitwise_or.reduce(chosen)
            at = np.minimum(np.searchsorted(held, near), len(held) - 1)
            hit = np.flatnonzero((held[at] == near) & (near > held))
            forest.merge(rows[order[hit]], rows[order[at[hit]]])


def _along(keys, fps, forest: Forest, rows) -> None:
    """Merge linked fingerprints that stand in the same run of equal keys. rows: their rows in forest."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    short = np.repeat(sizes <= 64, sizes)
    for step in range(1, 64):
        i = np.flatnonzero(short[:-step] & (keys[step:] == keys[:-step])) if len(keys) > step else []
        if not len(i):
            break
        hit = i[_linked(fps[i], fps[i + step])]
        forest.merge(rows[hit], rows[hit + step])
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        own, at = fps[s : s + n], rows[s : s + n]
        if n > LONG and (inner := _split(own)) is not None:
            for k, o in inner:
                _along(k[o], own[o], forest, at[o])
            continue
        if n > 4 * LONG:
            _neighbours(own, at, forest)
            continue
        for i in range(0, n, 256):
            a, b = np.nonzero(_linked(own[i : i + 256, None], own[None, i:]))
            forest.merge(at[a + i], at[b + i])


def _split(fps):
    """The same fingerprints, by each two of the positions in which they are not all equal: of five
    or more such positions two at least are shared by a link. None where fewer are left."""
    import numpy as np

    differ = np.bitwise_or.reduce(fps ^ fps[0])
    free = [p for p in range(8) if int(differ) >> (8 * p) & 0xFF]
    if len(free) < MAX_BITS + 2:
        return None
    out = []
    for i, p in enumerate(free):
        for q in free[i + 1 :]:
            k = (fps >> np.uint64(8 * p) & np.uint64(0xFF)) << np.uint64(8) | fps >> np.uint64(8 * q) & np.uint64(0xFF)
            out.append((k, np.argsort(k, kind="stable")))
    return out


def _forests(batches: Iterator) -> Iterator:
    """Rows (key, fp), sorted by key, to links (a, b) that span each posting's components."""
    import numpy as np
    import pyarrow as pa

    def links(keys, fps):
        forest = Forest(len(keys))
        if len(keys) > 1:
            _along(keys, fps, forest, np.arange(len(keys)))
        i = np.flatnonzero(forest.root != np.arange(len(keys)))
        a, b = fps[forest.root[i]].view(np.int64), fps[i].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in batches:
        keys = np.r_[keys, b.column("key").to_numpy(zero_copy_only=False)]
        fps = np.r_[fps, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
        if len(keys) and keys[0] != keys[-1]:
            cut = np.searchsorted(keys, keys[-1])
            yield links(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield links(keys, fps)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints fp."""
    posted = nodes.select("fp", F.posexplode(F.array(*_postings("fp"))).alias("way", "key"))
    found = posted.agg(F.expr(f"approx_top_k(key, 1000, {TRACKED})").alias("top")).first()["top"] or []
    if wide := [r["item"] for r in found if r["count"] > WIDE]:
        # 1,000 keys at most
        known = F.broadcast(nodes.sparkSession.createDataFrame([(k, True) for k in wide], "key long, wide boolean"))
        posted = posted.join(known, "key", "left")
        keys = F.when(F.col("wide").isNull(), F.array("key"))
        for way, triple in enumerate(TRIPLES):
            rest = itertools.combinations([p for p in range(8) if p not in triple], 2)
            byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF))
            keys = keys.when(F.col("way") == way, F.array(*[F.xxhash64("key", F.lit(10 * p + q), byte(p), byte(q)) for p, q in rest]))
        posted = posted.select("fp", F.explode(keys).alias("key"))
    dealt = posted.repartition("key").sortWithinPartitions("key").select("key", "fp")
    return dealt.mapInArrow(_forests, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node reachable.

    Alternating large-star and small-star steps; each result is a table in the shared folder, and a
    count with a sum of hashes tells when nothing changes any more."""

    def star(edges: DataFrame, both_ways: bool) -> DataFrame:
        if both_ways:
            near = edges.union(edges.select("b", "a")).toDF("u", "v")
        else:
            near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = near.join(least, "u")
        if both_ways:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.filter("a <> b").distinct()

    now, seen = materialize(edges.filter("a <> b").distinct(), "links"), None
    while True:
        step = materialize(star(star(now, True), False), "links")
        drop(now)
        now = step
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == seen or not told[0]:
            break
        seen = told
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())


def _with_component(marked: DataFrame, least) -> DataFrame:
    """marked (with fp) plus component: the least value of the expression least that is reachable."""
    nodes = materialize(marked.groupBy("fp").agg(least.alias("own")), "nodes")
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    per_root = nodes.groupBy("root").agg(F.min("own").alias("component"))
    of_fp = nodes.join(per_root, "root").select("fp", "component")
    return marked.join(of_fp, "fp")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex and component_id of every document."""
    marked = materialize(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    out = _with_component(marked, F.min("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the least (doc_id, hash of its columns)."""
    key = F.struct(F.col("doc_id").alias("d"), F.xxhash64(*hashable(docs)).alias("h"), F.hash(*hashable(docs)).alias("g"))
    marked = materialize(fingerprints(docs.select(key["d"].alias("d"), key["h"].alias("h"), key["g"].alias("g"), "text")), "fingerprints")
    lasting = _with_component(marked, F.min(F.struct("d", "h", "g"))).select(F.col("component.*")).distinct()
    own = docs.select(F.struct(*as_columns(docs)).alias("row"), key.alias("key")).select("row", "key.h", "key.g")
    kept = own.join(lasting.select("h", "g"), ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    return kept.select("row.*")
