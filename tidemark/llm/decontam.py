"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to `rate` edits per character, whatever its length. It is split into one
piece more than that error budget, so that any occurrence within the budget holds at least one piece
unchanged. All pieces are searched for at once: the eight bytes at every place of a text are looked up in a
bitmap of the pieces' first eight bytes (five, for the shorter pieces of items under 40 characters),
survivors in the pieces themselves. A hit is verified upwards in a binary tree over the
pieces: of c neighbouring pieces with fewer than c errors, one half has fewer errors than pieces too.
Each node is held against the text around the hit by Myers' bit-parallel distance with the node's own
budget, so chance hits of short pieces cost a few steps, and no occurrence is lost. The root gives the
distance and the end of the best occurrence, the first of equally good ones.

Texts are compared in lower case with runs of white space as one space. Items go to the executors in
blocks of at most BLOCK_CHARS characters; a larger benchmark takes more passes over the documents.

Defined cases: null and blank documents hold no item; null and blank items are in no document. Items
under 1 / rate characters are found unchanged only. An occurrence lies within one document, whatever
characters that and the item hold. Very long texts are searched whole, a mebibyte or one text at a time.
Rows of the benchmark with one id and different texts are items of their own, equal ones count once;
repeated documents are rows of their own. Empty tables give empty results.
Other columns are not read by `matches`, and pass through `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
#: Bytes at the head of a piece by which it is looked up; shorter ones are searched for one by one.
HEADS = (8, 5)
BLOCK_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern_bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of the pattern in text with at most `most` edits, the
    first of equally good ones. Bits run over the pattern, one step for each character of text."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = mask, 0, m, most + 1, -1
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, at = score, i + 1
        xv = eq | mv
        ph = ph << 1 & mask
        pv = (mh << 1 & mask) | (~(xv | ph) & mask)
        mv = ph & xv
    return (best, at) if at >= 0 else None


def _bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Item:
    """An item cut into pieces, and the tree over them."""

    def __init__(self, item_id, text: str, rate: float) -> None:
        self.id, self.text, m = item_id, text, len(text)
        self.budget = min(int(rate * m), m - 1)
        n = self.budget + 1
        self.cuts = [m * k // n for k in range(n + 1)]
        self.bits: dict[tuple[int, int], dict[str, int]] = {}
        #: From each piece up to the root: ranges of pieces.
        self.ways = [self._way(k, n) for k in range(n)]

    @staticmethod
    def _way(k: int, n: int) -> list[tuple[int, int]]:
        lo, hi, way = 0, n, []
        while hi - lo > 1:
            way.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if k < mid else (mid, hi)
        return way[::-1]

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(distance, start of the window, end) if the piece found at `at` is part of an occurrence."""
        if not self.ways[piece]:
            return 0, at, at + len(self.text)
        if not self._near(text, piece, at):
            return None
        for lo, hi in self.ways[piece]:
            most, a, b = hi - lo - 1, self.cuts[lo], self.cuts[hi]
            if (lo, hi) not in self.bits:
                self.bits[lo, hi] = _bits(self.text[a:b])
            start = max(0, at - (self.cuts[piece] - a) - most)
            window = text[start : at + (b - self.cuts[piece]) + most]
            found = myers(self.bits[lo, hi], b - a, window, most)
            if found is None:
                return None
        return found[0], start, start + found[1]


    def _near(self, text: str, piece: int, at: int) -> bool:
        """Whether the next node can match at all: it then has one error at most, all in the piece's
        neighbours, so with a single neighbour one half of that stands within one character of its place."""
        lo, hi = self.ways[piece][0]
        if hi - lo != 2:
            return True
        other = lo if piece == hi - 1 else hi - 1
        a, b = self.cuts[other], self.cuts[other + 1]
        mid, place = (a + b) // 2, at + a - self.cuts[piece]
        return self.text[a:mid] in text[max(0, place - 1) : place + mid - a + 1] or self.text[mid:b] in text[max(0, place + mid - a - 1) : place + b - a + 1]


class Finder:
    """All items at once. Texts are searched as UTF-8, many at a time."""

    _FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, items: list[tuple], rate: float) -> None:
        import numpy as np

        self.items = [Item(i, t, rate) for i, t in items]
        #: By length of the head, then by the head: (piece, [(item, which piece)]).
        self.pieces: dict[int, dict[int, dict[bytes, list[tuple[int, int]]]]] = {width: {} for width in HEADS}
        self.short: dict[bytes, list[tuple[int, int]]] = {}
        for n, x in enumerate(self.items):
            for k in range(x.budget + 1):
                p = x.text[x.cuts[k] : x.cuts[k + 1]].encode()
                width = next((w for w in HEADS if len(p) >= w), 0)
                near = self.pieces[width].setdefault(int.from_bytes(p[:width], "little"), {}) if width else self.short
                near.setdefault(p, []).append((n, k))
        self.tables = []
        for width, pieces in self.pieces.items():
            if pieces:
                heads = np.array(sorted(pieces), np.uint64)
                # at least sixteen slots for each head, so that few others get through
                bits = max(20, (16 * len(heads)).bit_length())
                bitmap = np.zeros(1 << bits, bool)
                bitmap[self._slots(heads, bits)] = True
                self.tables.append((width, heads, bits, bitmap))

    def _slots(self, heads, bits: int):
        import numpy as np

        return (heads * np.uint64(self._FACTOR) >> np.uint64(64 - bits)).astype(np.int64)

    def _hits(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Places at which a head of a piece stands, in order, and the length of the head. data ends in eight bytes
        that belong to no text."""
        import numpy as np

        found = []
        for shift in range(8):
            n = (len(data) - shift) // 8
            eight = np.frombuffer(data, "<u8", n, shift)
            for width, known, bits, bitmap in self.tables:
                heads = eight & np.uint64((1 << 8 * width) - 1) if width < 8 else eight
                at = np.flatnonzero(bitmap[self._slots(heads, bits)])
                at = at[np.isin(heads[at], known)]
                found.append((at * 8 + shift) << 4 | width)
        return ((x >> 4, x & 15) for x in np.sort(np.concatenate(found)).tolist()) if found else iter(())

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """(item id, distance, end, characters of the item) of the best occurrence of each item, for each text."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(normal(t or ""))
            size += len(held[-1])
            if size > 1 << 20:
                out += self._search(held)
                held, size = [], 0
        return out + self._search(held)

    def _search(self, texts: list[str]) -> list[list[tuple]]:
        coded = [t.encode() for t in texts]
        data, starts, at = b"\0".join([*coded, b"\0" * 8]), [], 0
        for c in coded:
            starts.append(at)
            at += len(c) + 1
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        done: list[set[tuple[int, int]]] = [set() for _ in texts]

        def check(doc: int, own: int, owners: list[tuple[int, int]]) -> None:
            where = own if len(coded[doc]) == len(texts[doc]) else len(coded[doc][:own].decode())
            self._verify(texts[doc], where, owners, best[doc], done[doc])

        doc = 0
        for place, width in self._hits(data):
            while doc + 1 < len(starts) and starts[doc + 1] <= place:
                doc += 1
            own = place - starts[doc]
            for p, owners in self.pieces[width][int.from_bytes(data[place : place + width], "little")].items():
                if own + len(p) <= len(coded[doc]) and data.startswith(p, place):
                    check(doc, own, owners)
        for p, owners in self.short.items():
            for doc, c in enumerate(coded):
                own = c.find(p)
                while own >= 0:
                    check(doc, own, owners)
                    own = c.find(p, own + 1)
        return [[(self.items[n].id, d, end, len(self.items[n].text)) for n, (d, end) in sorted(known.items())] for known in best]

    def _verify(self, text: str, at: int, owners: list[tuple[int, int]], best: dict[int, tuple[int, int]], done: set[tuple[int, int]]) -> None:
        for n, k in owners:
            x, known = self.items[n], best.get(n)
            line = n, at - x.cuts[k]
            # nothing is better than no edit, and unshifted pieces of an occurrence lead to the same window
            if known and known[0] == 0 or line in done:
                continue
            if found := x.verify(text, k, at):
                done.add(line)
                best[n] = min((found[0], found[2]), known or (len(x.text), 0))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, normalised, in lists of bounded size. One block at a time is on the driver."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_CHARS)
    for b in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b).collect()
        pairs = sorted({(r["item_id"], normal(r["text"])) for r in own}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if pairs := [p for p in pairs if p[1]]:
            yield pairs


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, end (in the normalised
    text, behind the best occurrence) and item_chars."""
    shape = "doc_id long, item_id long, distance int, end long, item_chars int"
    out = None
    for items in _blocks(benchmark):

        def search(batches, items=items):
            import pyarrow as pa

            finder = Finder(items, rate)
            for b in batches:
                rows = [(d, *x) for d, found in zip(b.column("doc_id").to_pylist(), finder.search(b.column("text").to_pylist())) for x in found]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "distance", "end", "item_chars"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, shape)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], shape)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, in one pass without a shuffle for each block of items."""
    names = docs.columns
    at = names.index("text")
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow maps don't take every name
    for items in _blocks(benchmark):

        def clean(batches, items=items):
            import pyarrow as pa

            finder = Finder(items, rate)
            for b in batches:
                yield b.filter(pa.array([not found for found in finder.search(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs.toDF(*names)
