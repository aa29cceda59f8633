"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts make a group that stays in one shard. Items sorted by size enter the open bin with the
tightest remaining capacity that still holds them, found in a balanced tree of remaining capacities.

The number of groups grows with the corpus, that of different sizes hardly does: D of them take D^2 / 2 bytes
at least. So the driver packs sizes with their counts: of n equal items as many enter the tightest bin as it
holds, which is what packing them one by one does. The outcome is a list of runs (size, first, count, bin):
group number k of a size, in the order of its hash, is in the bin whose run covers k. Every group is packed
by its own size, however small, and none is split. With a fixed number of shards the capacity is the smallest
for which best-fit-decreasing needs no more of them, so shards come out nearly equal; with a fixed capacity
the number of shards is what best-fit-decreasing needs. A group larger than a shard's share has a shard to
itself, and the others are balanced over the rest: a shard's share then is what remains over the shards that
remain.

Groups of one size are numbered in parts of PART about; the few groups that hold a thousandth of all rows or
more reach their rows by broadcast (at most 1,024 of them), the others by a join.

Defined cases: a null text counts as an empty one. Null and repeated doc_ids and repeated rows are
rows like any other. An empty table gives an empty result. Other columns are not read. A very long text is
a large item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

SHARDS = 40
ROW_BYTES = 16
#: Rows numbered together within a shard, about.
SLOT_ROWS = 1024
#: Groups of one size that are numbered together, about.
PART = 1 << 16
HEAVY = 1024


class BinTree:
    """Balanced search tree (AA tree) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.top = None

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key) -> None:
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.top = put(self.top)

    def remove(self, key) -> None:
        level = lambda t: t[1] if t else 0

        def cut(t, key):
            if t is None:
                return None
            if key == t[0]:
                if t[2] is None:
                    return t[3]
                if t[3] is None:
                    return t[2]
                below = t[3]
                while below[2]:
                    below = below[2]
                t[0] = below[0]
                t[3] = cut(t[3], below[0])
            else:
                side = 2 if key < t[0] else 3
                t[side] = cut(t[side], key)
            should = min(level(t[2]), level(t[3])) + 1
            if should < t[1]:
                t[1] = should
                if t[3] and should < t[3][1]:
                    t[3][1] = should
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.top = cut(self.top, key)

    def tightest(self, size: int):
        """The least key whose capacity is size or more; None if there is none."""
        t, best = self.top, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item, in bins of one capacity; the number of bins is max + 1. An item larger than
    the capacity has a bin of its own."""
    tree, bins, out = BinTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if (found := tree.tightest(sizes[i])) is None:
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        else:
            tree.remove(found)
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


Counts = list[tuple[int, int]]
#: (size, number of the first item of that size, items, bin, items a bin): later items are in the bins that follow.
Run = tuple[int, int, int, int, int]


def pack_counts(counts: Counts, capacity: int, most: int | None = None) -> list[Run] | None:
    """Best-fit-decreasing of (size, number of items) in descending order; None if it takes more than most bins."""
    tree, bins, runs = BinTree(), 0, []
    for size, n in counts:
        first = 0
        while first < n and (found := tree.tightest(size)) is not None:
            k = min(n - first, found[0] // size)
            tree.remove(found)
            tree.add((found[0] - k * size, found[1]))
            runs.append((size, first, k, found[1], k))
            first += k
        if first < n:
            room = max(capacity, size)
            per = room // size
            new = -(-(n - first) // per)
            if most is not None and bins + new > most:
                return None
            runs.append((size, first, n - first, bins, per))
            for b in range(bins, bins + new):
                tree.add((room - size * min(per, n - first), b))
                first += per
            bins += new
    return runs


def beyond_share(counts: Counts, shards: int) -> tuple[int, int, int]:
    """Bytes and shards that remain when, the largest first, each item above the mean of what remains has a shard to
    itself, and the size of the largest other item. counts: in descending order."""
    total = sum(s * n for s, n in counts)
    for size, n in counts:
        for _ in range(n):
            if shards == 1 or size * shards <= total:
                return total, shards, size
            total, shards = total - size, shards - 1
    return total, shards, 0


def pack(counts: Counts, shards: int) -> tuple[int, list[Run]]:
    """(capacity, runs) at the smallest capacity, to 1/4096 of it, for which best-fit-decreasing needs no more than
    shards. An item above a shard's share has a bin to itself and leaves the capacity of the others as it is."""
    if not counts:
        return 1, []
    rest, left, largest = beyond_share(counts, shards)
    low = max(-(-rest // left), 1)
    if (best := pack_counts(counts, low, shards)) is not None:
        return low, best
    high = low + largest  # the emptiest of too few bins would hold any item that shares one
    best = pack_counts(counts, high, shards)
    while high - low > max(1, low >> 12):
        mid = (low + high) // 2
        if (found := pack_counts(counts, mid, shards)) is not None:
            high, best = mid, found
        else:
            low = mid
    return high, best


def _bins(groups: DataFrame, shards: int, capacity: int | None) -> DataFrame:
    """groups (h, g, size, n) with their bin."""
    spark = groups.sparkSession
    sizes = materialize(groups.groupBy("size").agg(F.count("*").alias("items")), "group-sizes")
    counts = sorted(((r["size"], r["items"]) for r in sizes.collect()), reverse=True)  # see above: few
    runs = pack(counts, shards)[1] if capacity is None else pack_counts(counts, capacity)
    of_run = spark.createDataFrame(runs, "size long, first long, items long, bin long, per long").withColumnRenamed("items", "covers")
    parts = F.ceil(F.col("items") / PART).cast("long")
    dealt = groups.join(sizes, "size").withColumn("part", F.pmod("h", parts)).drop("items")
    cells = dealt.groupBy("size", "part").count()
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("size", "part").orderBy("h", "g"))
    numbered = dealt.withColumn("k", number - 1).join(cells, ["size", "part"]).withColumn("k", F.col("start") + F.col("k"))
    covers = (numbered["size"] == of_run["size"]) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("covers"))
    bin_of = F.col("bin") + F.expr("(k - first) div per")
    return numbered.join(of_run, covers).select("h", "g", "n", bin_of.cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. With a capacity (in bytes) there are
    as many shards as that takes, in place of the number given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(text, F.lit(1)).alias("g"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    groups = materialize(rows.groupBy("h", "g").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    count = groups.agg(F.sum("n")).first()[0] or 0
    placed = materialize(_bins(groups, shards, capacity), "bins")
    heavy = F.broadcast(placed.filter(F.col("n") * HEAVY > count).select("h", "g", F.col("shard").alias("own")))  # HEAVY rows at most
    told = rows.join(heavy, ["h", "g"], "left")
    light = placed.filter(F.col("n") * HEAVY <= count).select("h", "g", "shard")
    # numbered in parts: rows equal in doc_id and text may be very many, so those of heavy groups are dealt by row too
    parts = F.lit(max(1, -(-count // (shards * SLOT_ROWS))))
    wide = told.filter("own IS NOT NULL").select("doc_id", "size", "text_crc32", F.col("own").alias("shard"), F.pmod(F.xxhash64("doc_id", "row"), parts).alias("part"))
    rest = told.filter("own IS NULL").join(light, ["h", "g"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), parts).alias("part"))
    dealt = wide.union(rest)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("n", F.row_number().over(within)).join(starts, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
