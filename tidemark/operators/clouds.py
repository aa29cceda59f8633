"""Entropic transport between whole tables of points. Points are packed into blocks; the costs of two blocks are made in a
task, used and forgotten, and what each pair gives a point (a maximum and a sum of exponentials) is merged by aggregation.
Potentials are tables, a packed row for each block, so the driver holds a number for each sweep and a bounded start.

Cases: a point table without rows raises TransportError; null or non-finite vectors, or vectors of several lengths in a
block, fail the job with its message; repeated points count as often as they stand; ids may repeat and are only carried."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import transport
from tidemark.operators.transport import TransportError
from tidemark.sources.frames import materialize

#: Points of a block: two of these and a strip of their costs are what a task holds.
BLOCK = 4096
#: Groups that each side's blocks are dealt to, if it has so many, and the blocks of a group at most: what a task holds.
SPREAD, HELD = 6, 32
#: Parts that are merged at a time.
FAN = 64
#: Turns whose potentials are mixed to the next one.
DEPTH = 6
#: Rows and columns of a strip of costs: few enough to stay in a core's cache.
STRIP = 128, 1024
#: Ranges of costs that a pass tells apart, and costs that the driver takes at most, in the search for a median.
BINS, TAKEN = 1 << 16, 1 << 18


@dataclass(frozen=True)
class Cloud:
    """blocks: block int, n int, ids array, x binary (n rows of numbers). n: points; parts: blocks at most; kind: of the
    numbers, floats where the table has floats, which lose nothing and are half as long."""

    blocks: DataFrame = field(repr=False)
    n: int
    parts: int
    kind: str = "f8"


def _packed(batches: Iterator, kind: str) -> Iterator:
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    kept = [b for b in batches if len(b)]
    if not kept:
        return
    rows = pd.concat(kept)
    vectors = rows["x"].to_numpy()
    if any(v is None for v in vectors) or len({len(v) for v in vectors}) != 1:
        raise TransportError("vectors must be there and of one length")
    x = np.stack(vectors).astype(kind)
    if not np.isfinite(x).all():
        raise TransportError("vectors must be finite")
    yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "n": [len(x)], "ids": [rows["id"].tolist()], "x": [x.tobytes()]})


def cloud(df: DataFrame, ident: str, vector: str, block: int = BLOCK) -> Cloud:
    """The points of a table, packed once into blocks of about that many and written to the shared folder."""
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("x"))
    n = rows.count()
    if n == 0:
        raise TransportError("a cloud needs points")
    parts = -(-n // block)
    ids = rows.schema["id"].dataType.simpleString()
    kind = "f4" if rows.schema["x"].dataType.simpleString() == "array<float>" else "f8"
    packed = rows.repartition(parts).mapInPandas(partial(_packed, kind=kind), f"block int, n int, ids array<{ids}>, x binary")
    return Cloud(materialize(packed, "cloud"), n, parts, kind)


def _strips(x, y):
    """Costs of x to y, a strip at a time: where it is, as two slices, and the costs."""
    import numpy as np

    rows, columns = STRIP
    left = np.concatenate([-2 * x, (x * x).sum(1)[:, None], np.ones((len(x), 1))], 1)
    right = np.concatenate([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]], 1)
    for j in range(0, len(y), columns):
        part = np.ascontiguousarray(right[j : j + columns].T)
        for i in range(0, len(x), rows):
            cost = left[i : i + rows] @ part
            yield (slice(i, i + rows), slice(j, j + columns)), np.maximum(cost, 0.0, out=cost)


def _points(x: bytes, n: int, kind: str):
    import numpy as np

    return np.frombuffer(x, kind).reshape(n, -1).astype(float)


def _grid(parts: tuple[int, int]) -> tuple[int, int]:
    """Groups of each side: SPREAD, more where the other side has few blocks, or as many as HELD asks for."""
    p, q = parts
    rows, cols = min(p, max(SPREAD, SPREAD**2 // q)), min(q, max(SPREAD, SPREAD**2 // p))
    return max(rows, -(-p // HELD)), max(cols, -(-q // HELD))


def _tiles(mine: DataFrame, theirs: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """Blocks (block, n, x, v) of both sides, `own` for the first, dealt to tiles, which are a group of each side and a
    partition each. A block is sent once for each group of the other side, of which there are SPREAD however many blocks
    there are, until a group of HELD blocks is full."""
    rows, cols = grid
    sent = lambda of, own, tile, n: of.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.lit(own).alias("own"), tile.cast("int").alias("tile"), "block", "n", "x", "v")
    first = sent(mine, True, F.col("block") % rows * cols + F.col("__k"), cols)
    second = sent(theirs, False, F.col("__k") * cols + F.col("block") % cols, rows)
    return first.unionAll(second).repartitionById(rows * cols, "tile")


def _met(batches: Iterator, kinds: tuple[str, str]) -> Iterator:
    """Of each tile: its number, and a list for each side of block, points and v."""
    import numpy as np
    import pandas as pd

    kept = [b for b in batches if len(b)]
    for tile, rows in pd.concat(kept).groupby("tile") if kept else ():
        sides = []
        for own, kind in zip((True, False), kinds):
            held = rows[rows["own"] == own]
            sides.append([(r.block, _points(r.x, r.n, kind), None if r.v is None else np.frombuffer(r.v)) for r in held.itertuples()])
        yield tile, *sides


def _soft(batches: Iterator, level: float, kinds: tuple[str, str], cols: int) -> Iterator:
    """Of each tile: for every point of its first side the greatest exponent and the sum of exponentials below it. One product
    of a strip gives its exponents, up to the norms of the first side's points, which are set off at the end."""
    import numpy as np
    import pandas as pd

    rows, columns = STRIP
    for tile, mine, theirs in _met(batches, kinds):
        parts = []
        while theirs:
            _, y, v = theirs.pop()
            right = np.concatenate([y, ((v - (y * y).sum(1)) / level)[:, None]], 1).T
            parts += [np.ascontiguousarray(right[:, j : j + columns]) for j in range(0, right.shape[1], columns)]
        buffer = np.empty(rows * columns)
        for block, x, _ in mine if parts else ():
            top, total = np.full(len(x), -np.inf), np.zeros(len(x))
            left = np.concatenate([x * (2 / level), np.ones((len(x), 1))], 1)
            for i in range(0, len(x), rows):
                at, own = slice(i, i + rows), left[i : i + rows]
                for part in parts:
                    a = np.matmul(own, part, out=buffer[: len(own) * part.shape[1]].reshape(len(own), -1))
                    high = np.maximum(top[at], a.max(1))
                    a -= high[:, None]
                    total[at] = total[at] * np.exp(top[at] - high) + np.exp(a, out=a).sum(1)
                    top[at] = high
            top -= (x * x).sum(1) / level
            yield pd.DataFrame({"block": [block], "other": [tile % cols], "top": [top.tobytes()], "total": [total.tobytes()]})


def _merged(pdf):
    """FAN parts of one block at most, as one."""
    import numpy as np
    import pandas as pd

    top = np.stack([np.frombuffer(t) for t in pdf["top"]])
    total = np.stack([np.frombuffer(t) for t in pdf["total"]])
    high = top.max(0)
    total = (np.exp(top - high) * total).sum(0)
    return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "other": pdf["group"].iloc[:1].to_numpy(), "top": [high.tobytes()], "total": [total.tobytes()]})


#: A number above those of all finite costs.
_END = 0x7FF0000000000000


def _between(batches: Iterator, low: int, high: int, kinds: tuple[str, str]) -> Iterator:
    """Of each tile, a part at a time: how many costs are below low, and the numbers of those from low up to high. The bits of
    a double that is not negative are a number of the same order."""
    import numpy as np

    ends = np.array([low, high], np.int64).view(float)
    for _, mine, theirs in _met(batches, kinds):
        for _, x, _ in mine:
            for _, y, _ in theirs:
                below, found, held = 0, [], 0
                for _, cost in _strips(x, y):
                    under = cost < ends[0]
                    below += int(np.count_nonzero(under))
                    inside = cost < ends[1]
                    inside &= ~under
                    found.append(cost[inside])
                    held += len(found[-1])
                    if held >= TAKEN:
                        yield below, np.concatenate(found).view(np.int64)
                        below, found, held = 0, [], 0
                yield below, np.concatenate([*found, np.zeros(0)]).view(np.int64)


def _counted(batches: Iterator, low: int, high: int, shift: int, kinds: tuple[str, str]) -> Iterator:
    """How many costs are in each range of 2 ** shift numbers from low up to high; range -1: those below."""
    import numpy as np
    import pandas as pd

    total, counts = 0, np.zeros(((high - 1 - low) >> shift) + 1, np.int64)
    for below, found in _between(batches, low, high, kinds):
        total += below
        counts += np.bincount((found - low) >> shift, minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"bin": np.append(at, -1), "n": np.append(counts[at], total)})


def _listed(batches: Iterator, low: int, high: int, kinds: tuple[str, str]) -> Iterator:
    """Distinct costs from low up to high, as numbers, with how often each is there; number -1: those below."""
    import numpy as np
    import pandas as pd

    for below, found in _between(batches, low, high, kinds):
        bins, n = np.unique(found, return_counts=True)
        yield pd.DataFrame({"bin": np.append(bins, -1), "n": np.append(n, below)})


def _ends(batches: Iterator, edge: int, kinds: tuple[str, str]) -> Iterator:
    """The greatest cost below the edge and the least from it on, of each tile."""
    import numpy as np
    import pandas as pd

    cut = np.array([edge], np.int64).view(float)[0]
    for _, mine, theirs in _met(batches, kinds):
        for _, x, _ in mine:
            for _, y, _ in theirs:
                pairs = [(cost[cost < cut].max(initial=-np.inf), cost[cost >= cut].min(initial=np.inf)) for _, cost in _strips(x, y)]
                yield pd.DataFrame([(max(a for a, _ in pairs), min(b for _, b in pairs))], columns=["under", "over"])


def median_cost(h: Cloud, b: Cloud, near: tuple[float, float] = (0.0, 0.0)) -> float:
    """The median of the costs of all pairs of two clouds, by counting them in ranges that close in on it: every pass makes all
    costs again and keeps none. near: where the median may be, which can save passes and changes nothing else."""
    import numpy as np

    n, kinds = h.n * b.n, (h.kind, b.kind)
    ranks = (n - 1) // 2, n // 2
    mine, theirs = (of.blocks.select("block", "n", "x", F.lit(None).cast("binary").alias("v")) for of in (h, b))
    tiles = lambda: _tiles(mine, theirs, _grid((h.parts, b.parts)))

    def summed(f, **how) -> tuple:
        rows = tiles().mapInPandas(partial(f, kinds=kinds, **how), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
        return rows["bin"].to_numpy(), np.cumsum(rows["n"].to_numpy())

    low, high = (int(k) for k in np.array(near, float).view(np.int64))
    if not 0 <= low < high < _END:
        low, high = 0, _END
    while True:
        shift = max(0, (high - low - 1).bit_length() - BINS.bit_length() + 1)
        bins, upto = summed(_counted, low=low, high=high, shift=shift)
        cuts = lambda k: (0, low) if k < 0 else (low + (k << shift), min(low + (k + 1 << shift), high))  # noqa: B023, E731
        own = [cuts(int(bins[i])) if i < len(bins) else (high, _END) for i in np.searchsorted(upto, ranks, "right")]
        if own[0] != own[1]:  # one ends a range, the other begins one
            two = tiles().mapInPandas(partial(_ends, edge=own[1][0], kinds=kinds), "under double, over double").agg(F.max("under"), F.min("over")).first()
            return (two[0] + two[1]) / 2
        i = int(np.searchsorted(upto, ranks[0], "right"))
        held = upto[i] - (upto[i - 1] if i else 0) if i < len(bins) and bins[i] >= 0 else n
        low, high = own[0]
        if high - low == 1:
            return float(np.array([low], np.int64).view(float)[0])
        if held <= TAKEN:
            bins, upto = summed(_listed, low=low, high=high)
            return float(bins[np.searchsorted(upto, ranks, "right")].view(float).mean())


def _potential(batches: Iterator, level: float, size: int) -> Iterator:
    import numpy as np
    import pandas as pd

    for b in batches:
        v = [(-level * (np.frombuffer(t) + np.log(np.frombuffer(s)) - np.log(size))).tobytes() for t, s in zip(b["top"], b["total"])]
        yield pd.DataFrame({"block": b["block"], "v": v})


def soft_min(points: Cloud, other: Cloud, potential: DataFrame, level: float) -> DataFrame:
    """What a potential (block, v) on a cloud is at other points: the soft minimum of cost less potential. block, v."""
    grid = _grid((points.parts, other.parts))
    mine = points.blocks.select("block", "n", "x", F.lit(None).cast("binary").alias("v"))
    tiles = _tiles(mine, other.blocks.select("block", "n", "x").join(potential, "block"), grid)
    kinds = "block int, other int, top binary, total binary"
    parts, left = tiles.mapInPandas(partial(_soft, level=level, kinds=(points.kind, other.kind), cols=grid[1]), kinds), grid[1]
    while left > 1:
        parts = parts.withColumn("group", F.expr(f"other div {FAN}").cast("int")).groupBy("block", "group").applyInPandas(_merged, kinds)
        left = -(-left // FAN)
    return parts.mapInPandas(partial(_potential, level=level, size=other.n), "block int, v binary")


def _stepped(batches: Iterator, level: float) -> Iterator:
    """Of each block: its last potentials and what a turn changes each by, newest first; the marginal error summed over the
    newest; inner products of the changes."""
    import numpy as np
    import pandas as pd

    for b in batches:
        out = []
        for r in b.itertuples():
            g = np.frombuffer(r.g)
            gap = np.frombuffer(r.v) - g
            old = [g.tobytes(), *([] if r.old is None else r.old)][:DEPTH]
            gaps = [gap.tobytes(), *([] if r.gaps is None else r.gaps)][:DEPTH]
            stack = np.stack([np.frombuffer(x) for x in gaps])
            out.append((r.block, old, gaps, float(np.abs(np.expm1(-gap / level)).sum()), (stack @ stack.T).ravel().tolist()))
        yield pd.DataFrame(out, columns=["block", "old", "gaps", "error", "dots"])


def _mixed(batches: Iterator, weights) -> Iterator:
    import numpy as np
    import pandas as pd

    for b in batches:
        v = [sum(w * (np.frombuffer(g) + np.frombuffer(d)) for w, g, d in zip(weights, old, gaps)).tobytes() for old, gaps in zip(b["old"], b["gaps"])]
        yield pd.DataFrame({"block": b["block"], "v": v})


def _weights(dots) -> list[float]:
    """Weights of sum one that make the mixed change least, each change taken at its own length."""
    import numpy as np

    size = np.sqrt(np.maximum(np.diag(dots), 1e-300))
    z = np.linalg.solve(dots / np.outer(size, size) + 1e-10 * np.eye(len(size)), 1 / size) / size
    return (z / z.sum()).tolist()


def _carried(batches: Iterator, cloud, potential, eps: float, kind: str) -> Iterator:
    import pandas as pd

    for b in batches:
        yield pd.DataFrame({"block": b["block"], "v": [transport.extended(cloud, potential, eps, _points(r.x, r.n, kind)).tobytes() for r in b.itertuples()]})


def starting(references, eps: float, b: Cloud) -> DataFrame:
    """Potential on b from the solution between bounded references of both sides, carried to all its points."""
    import numpy as np

    near, far = references
    found = transport.potentials(near, far, eps)
    return b.blocks.mapInPandas(partial(_carried, cloud=near, potential=np.array(found["f"]), eps=eps, kind=b.kind), "block int, v binary")


def potentials(h: Cloud, b: Cloud, eps: float, start: DataFrame | None = None, tolerance: float = 1e-6, sweeps: int = 200, trace: list | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Entropic potentials on both clouds as tables (block, v), with marginals within the tolerance (L1), and the error. The
    one on h is the soft minimum of the one on b, whose table also has the soft minimum of the one on h, as `met`.

    Scaling in turns: after h's side is set its marginals are right, and the next step of b's side says how far b's are, so
    the certificate costs no pass of its own. The next potential on b is the mixture of the last DEPTH ones whose change is
    least, for which the driver needs their inner products alone; where a mixture did worse than a hundred times the best,
    the last turn's plain result is taken. start: a potential on b (`starting`), zero without. After `sweeps` turns a
    TransportError is raised: nothing that isn't certified is given out."""
    import numpy as np

    if eps <= 0:
        raise TransportError("needs a positive regularisation")
    g = start if start is not None else b.blocks.select("block", F.expr("cast(repeat(decode(unhex('00'), 'UTF-8'), 8 * n) as binary)").alias("v"))
    past = b.blocks.select("block", F.lit(None).cast("array<binary>").alias("old"), F.lit(None).cast("array<binary>").alias("gaps"))
    error, best = float("inf"), float("inf")
    for sweep in range(sweeps):
        f = materialize(soft_min(h, b, g, eps), "potential")
        turn = soft_min(b, h, f, eps).join(g.withColumnRenamed("v", "g"), "block").join(past, "block")
        past = materialize(turn.mapInPandas(partial(_stepped, level=eps), "block int, old array<binary>, gaps array<binary>, error double, dots array<double>"), "potential")
        depth = min(sweep + 1, DEPTH)
        total = past.agg(F.sum("error"), *[F.sum(F.element_at("dots", i + 1)) for i in range(depth * depth)]).first()
        past, error = past.select("block", "old", "gaps"), total[0] / b.n
        if trace is not None:
            trace.append({"sweep": sweep, "marginal_l1": error})
        if error <= tolerance:
            last = partial(_mixed, weights=[1.0])
            met = past.mapInPandas(last, "block int, v binary").withColumnRenamed("v", "met")
            return f, materialize(past.select("block", F.element_at("old", 1).alias("v")).join(met, "block"), "potential"), error
        weights = _weights(np.array(total[1:]).reshape(depth, depth)) if error <= 100 * best else [1.0]
        best = min(best, error)
        g = past.mapInPandas(partial(_mixed, weights=weights), "block int, v binary")
    raise TransportError(f"marginal error {error} after {sweeps} sweeps")


def by_point(points: Cloud, potential: DataFrame, name: str) -> DataFrame:
    """id and number of each point."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            b["v"] = [np.frombuffer(v).tolist() for v in b["v"]]
            yield b

    kind = points.blocks.schema["ids"].dataType.simpleString()
    flat = points.blocks.select("block", "ids").join(potential, "block").select("ids", "v").mapInPandas(rows, f"ids {kind}, v array<double>")
    return flat.select(F.explode(F.arrays_zip("ids", "v")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.v").alias(name))


def _less(v: DataFrame, w: DataFrame) -> DataFrame:
    """Differences of two tables (block, v)."""
    import numpy as np

    def less(batches: Iterator) -> Iterator:
        import pandas as pd

        for p in batches:
            yield pd.DataFrame({"block": p["block"], "v": [(np.frombuffer(v) - np.frombuffer(w)).tobytes() for v, w in zip(p["v"], p["w"])]})

    return v.select("block", "v").join(w.select("block", F.col("v").alias("w")), "block").mapInPandas(less, "block int, v binary")


def _own(h: Cloud, b: Cloud, f: DataFrame, g: DataFrame, eps: float) -> tuple[DataFrame, DataFrame, float]:
    """How much farther each cloud's points are from b's side than from h's, and the mean over both. What a potential is on the
    other side is there since it was solved; only each side against itself is worked out."""

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for p in batches:
            yield pd.DataFrame({"s": [float(np.frombuffer(v).sum()) for v in p["v"]]})

    own = materialize(_less(f, soft_min(h, h, f, eps)), "coordinate"), materialize(_less(soft_min(b, b, g.select("block", "v"), eps), g.select("block", F.col("met").alias("v"))), "coordinate")
    return *own, own[0].unionAll(own[1]).mapInPandas(summed, "s double").agg(F.sum("s")).first()[0] / (h.n + b.n)


def _away(points: Cloud, h: Cloud, b: Cloud, f: DataFrame, g: DataFrame, eps: float) -> DataFrame:
    return _less(soft_min(points, b, g.select("block", "v"), eps), soft_min(points, h, f, eps))


def coordinate(points: Cloud, h: Cloud, b: Cloud, f: DataFrame, g: DataFrame, eps: float) -> DataFrame:
    """How much farther each point is from b's side than from h's: id, coordinate, centred on both clouds. f and g as
    `potentials` gives them."""
    *_, centre = _own(h, b, f, g, eps)
    return by_point(points, _away(points, h, b, f, g, eps), "coordinate").withColumn("coordinate", F.col("coordinate") - centre)


def coordinates(h: Cloud, b: Cloud, f: DataFrame, g: DataFrame, eps: float, rest: Cloud | None = None) -> DataFrame:
    """`coordinate` of both clouds' own points, and of those of neither."""
    of_h, of_b, centre = _own(h, b, f, g, eps)
    out = by_point(h, of_h, "coordinate").unionAll(by_point(b, of_b, "coordinate"))
    if rest is not None:
        out = out.unionAll(by_point(rest, _away(rest, h, b, f, g, eps), "coordinate"))
    return out.withColumn("coordinate", F.col("coordinate") - centre)


def _costs(batches: Iterator, eps: float, cells: float, kinds: tuple[str, str]) -> Iterator:
    """Transported cost of each tile."""
    import numpy as np
    import pandas as pd

    for _, mine, theirs in _met(batches, kinds):
        parts = ((np.exp((f[at, None] + g[None, to] - cost) / eps) * cost).sum() for _, x, f in mine for _, y, g in theirs for (at, to), cost in _strips(x, y))
        yield pd.DataFrame({"cost": [float(sum(parts) / cells)]})


def distance(h: Cloud, b: Cloud, f: DataFrame, g: DataFrame, eps: float) -> float:
    """Root of the cost of the plan that two potentials stand for."""
    mine, theirs = (of.blocks.select("block", "n", "x").join(v, "block") for of, v in ((h, f), (b, g)))
    tiles = _tiles(mine, theirs, _grid((h.parts, b.parts)))
    total = tiles.mapInPandas(partial(_costs, eps=eps, cells=float(h.n) * b.n, kinds=(h.kind, b.kind)), "cost double").agg(F.sum("cost")).first()[0]
    return max(total, 0.0) ** 0.5
