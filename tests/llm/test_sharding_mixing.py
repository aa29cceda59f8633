import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, prose, words
from tidemark.llm import mixing, sharding


def brute_best_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(left) if room >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(max(capacity, sizes[i]))
        left[b] -= sizes[i]
        out[i] = b
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(20, 120))
def test_best_fit_equals_a_scan(sizes, capacity):
    assert sharding.best_fit_decreasing(sizes, capacity) == brute_best_fit(sizes, capacity)


def expand(runs):
    """Size and bin of every item of runs."""
    return sorted((size, b + k // per) for size, _, n, b, per in runs for k in range(n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(20, 120))
def test_packing_counts_is_packing_one_by_one(sizes, capacity):
    runs = sharding.pack_counts(sorted(Counter(sizes).items(), reverse=True), capacity)
    brute = list(zip(sizes, brute_best_fit(sizes, capacity)))
    got = expand(runs)
    assert sorted(s for s, _ in got) == sorted(sizes)
    of = lambda pairs: sorted(tuple(sorted(s for s, x in pairs if x == b)) for b in {b for _, b in pairs})
    assert of(got) == of(brute)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 30)), max_size=200))
def test_tree_equals_a_sorted_list(steps):
    tree, known = sharding.BinTree(), []
    for number, (add, x) in enumerate(steps):  # bins have numbers of their own
        if add:
            tree.add((x, number))
            known.append((x, number))
        elif known:
            tree.remove(known.pop(x % len(known)))
        assert tree.tightest(x) == min((k for k in known if k[0] >= x), default=None)


def check_shards(rows, out, shards=40):
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode()), "bytes", None) for r in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in out:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        groups[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_sharding(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(3000)] + [(5000 + i, "copy of one text " * 4) for i in range(60)]
    out = sharding.shard(docs(spark, rows)).collect()
    check_shards(rows, out)
    totals = Counter()
    for r in out:
        totals[r.shard] += r.size
    mean = sum(totals.values()) / 40
    assert max(totals.values()) < 1.002 * mean and min(totals.values()) > 0.99 * mean
    check_loads(rows, totals, lambda counts: sharding.pack(counts, 40)[0])


def check_loads(rows, totals, capacity_of):
    """Shards hold what packing the groups one by one, in bins of that capacity, puts into each."""
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t.encode()) + 16
    sizes = list(groups.values())
    loads = Counter()
    for size, b in zip(sizes, brute_best_fit(sizes, capacity_of(sorted(Counter(sizes).items(), reverse=True)))):
        loads[b] += size
    assert sorted(totals.values()) == sorted(loads.values())


@pytest.mark.parametrize("part", [1 << 16, 5])
def test_sharding_by_capacity(spark, monkeypatch, part):
    """As few shards as best-fit-decreasing needs; groups of a size numbered in one part or in many."""
    monkeypatch.setattr(sharding, "PART", part)
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.choice([3, 8, 40, rng.randrange(1, 300)]))) for i in range(800)] + [(5000 + i, "copy of one text " * 4) for i in range(90)]
    out = sharding.shard(docs(spark, rows), capacity=4000).collect()
    check_shards(rows, out, 10_000)
    totals = Counter()
    for r in out:
        totals[r.shard] += r.size
    assert sorted(totals) == list(range(len(totals)))
    check_loads(rows, totals, lambda _: 4000)


@pytest.mark.parametrize("giants", [(0.05,), (1 / 3,), (1 / 3, 0.05, 0.05), (0.9,)])
def test_a_group_beyond_a_share_leaves_the_others_balanced(giants):
    rng = random.Random(4)
    small = [rng.randrange(100, 1000) for _ in range(4000)]
    large = [int(g * sum(small) / (1 - sum(giants))) for g in giants]
    loads = Counter()
    for size, b in expand(sharding.pack(sorted(Counter(large + small).items(), reverse=True), 40)[1]):
        loads[b] += size
    mean = sum(small) / (40 - len(giants))
    others = sorted(loads.values())[: 40 - len(giants)]
    assert set(loads) == set(range(40)) and sorted(loads.values())[40 - len(giants) :] == sorted(large)
    assert others[-1] < 1.02 * mean and others[0] > 0.9 * mean


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60), st.integers(1, 5000)), min_size=1, max_size=80), st.integers(1, 12))
def test_pack_keeps_to_the_shards(sizes, shards):
    bins = [b for _, b in expand(sharding.pack(sorted(Counter(sizes).items(), reverse=True), shards)[1])]
    assert len(bins) == len(sizes) and 0 <= min(bins) and max(bins) < shards


def test_sharding_with_a_third_in_one_group(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(3000)]
    size = sum(len(t) + 16 for _, t in rows)
    copy = "copy of one text " * 40
    rows += [(5000 + i, copy) for i in range(size // 2 // (len(copy) + 16))]
    out = sharding.shard(docs(spark, rows)).collect()
    check_shards(rows, out)
    totals = Counter()
    for r in out:
        totals[r.shard] += r.size
    giant, *others = sorted(totals.values(), reverse=True)
    assert giant == size // 2 // (len(copy) + 16) * (len(copy) + 16)
    assert len(others) == 39 and others[0] < 1.02 * size / 39 and others[-1] > 0.9 * size / 39


def test_sharding_edges(spark):
    check_shards(edge_rows(), sharding.shard(edge_docs(spark)).collect())
    assert sharding.shard(empty_docs(spark)).collect() == []


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    capped = mixing.targets([10, 1000, 1000], [3, 1, 2])
    assert capped[0] == 30 and abs(sum(capped) - 2010) < 1e-9 and abs(capped[2] - 2 * capped[1]) < 1e-9
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50), st.floats(0, 0.999)), max_size=60))
def test_pivot_keeps_the_weighted_sum(units):
    p, s, u = ([x[k] for x in units] for k in range(3))
    done, held, q = mixing.pivot(range(len(units)), p, s, u)
    assert set(done.values()) <= {0, 1} and len(done) + (held is not None) == len(units)
    total = sum(s[i] * v for i, v in done.items()) + (s[held] * q if held is not None else 0)
    assert abs(total - sum(a * b for a, b in zip(p, s))) < 1e-5 * (1 + sum(s))


def test_pivot_keeps_expectations():
    rng, n, hits = random.Random(0), 4000, [0.0] * 5
    p, s = [0.2, 0.5, 0.7, 0.35, 0.9], [5, 40, 3, 17, 8]
    for _ in range(n):
        done, held, q = mixing.pivot(range(5), p, s, [rng.random() for _ in p])
        for i, v in done.items():
            hits[i] += v
        if held is not None:
            hits[held] += q
    assert all(abs(h / n - x) < 0.04 for h, x in zip(hits, p))


def check_mix(rows, out):
    n = lambda t: len(words(t))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], n(r[1])) for r in rows)
    assert all(0 <= r.copies <= 3 for r in out)


def test_settle_keeps_expectations_and_the_sum():
    rng = random.Random(1)
    for q, w, f, pool in ((0.3, 900, 0.25, 4000), (0.7, 900, 0.25, 1000), (0.5, 50, 0.9, 20), (0.4, 30, 0.5, 0)):
        units = fractions = 0.0
        for _ in range(4000):
            up, left = mixing.settle(q, w, f, pool, (rng.random(), rng.random()))
            assert 0 <= left <= 1
            if 0 < left < 1 and pool:
                assert abs(up * w + left * pool - q * w - f * pool) < 1e-6
            units, fractions = units + up, fractions + left
        assert abs(units / 4000 - q) < 0.03 and abs(fractions / 4000 - f) < 0.03


@pytest.mark.parametrize("block", [4096, 7])
def test_mix_meets_targets(spark, monkeypatch, block):
    """With small blocks the reduction tree has several levels; tables of sources too large to be sent are joined. The
    rule is the same."""
    monkeypatch.setattr(mixing, "SENT", 100_000 if block > 7 else 1)
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 60)), f"s{min(i % 9, 3)}") for i in range(1500)]
    out = mixing.mix(docs(spark, rows)).collect()
    check_mix(rows, out)
    taken, target = Counter(), {}
    for r in out:
        taken[r.source_size, r.target] += r.size * r.copies
    for (size, aim), got in taken.items():
        assert abs(got - aim) < 16, (size, aim, got)
    key = lambda rs: sorted((r.doc_id, r.copies) for r in rs)
    assert key(out) == key(mixing.mix(docs(spark, rows).repartition(7)).collect())


@pytest.mark.parametrize("n", [600, 20_000])
def test_mix_lands_sources_of_any_size(spark, n):
    """Each source has one very long document; sources have fewer rows than a block, or more."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 40)), f"s{i % 4}") for i in range(n)]
    rows += [(30_000 + i, prose(rng, n), f"s{i}") for i in range(4)]
    out = mixing.mix(docs(spark, rows)).collect()
    check_mix(rows, out)
    taken = Counter()
    for r in out:
        taken[r.source_size, r.target] += r.size * r.copies
    assert len(taken) == 4 and all(abs(got - aim) < 8 for (_, aim), got in taken.items()), [(round(got - aim, 1)) for (_, aim), got in taken.items()]


def test_mix_takes_every_length_alike(spark):
    """Documents are taken as often as their source's rate asks, short and long ones."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([2, 30, 100])), f"s{i % 2}") for i in range(6000)]
    out = mixing.mix(docs(spark, rows)).collect()
    for k in {r.target for r in out}:
        own = [r for r in out if r.target == k]
        for length in (2, 30, 100):
            copies = [r.copies for r in own if r.size == length]
            assert abs(sum(copies) / len(copies) - k / own[0].source_size) < 0.05


def test_equal_rows_are_one_unit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rng = random.Random(5)
    rows = [(1, prose(rng, 20), "a")] * 500 + [(2, prose(rng, 9), "b")] * 3 + [(i, prose(rng, 15), "b") for i in range(3, 300)]
    out = mixing.mix(docs(spark, rows)).collect()
    check_mix(rows, out)
    copies = Counter()
    for r in out:
        copies[r.doc_id] += r.copies
    rate = next(r.target / r.source_size for r in out if r.doc_id == 1)
    assert abs(copies[1] - 500 * rate) <= 1
    assert Counter(r.doc_id for r in mixing.apply_mix(docs(spark, rows)).collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mix_edges(spark):
    check_mix(edge_rows(), mixing.mix(edge_docs(spark)).collect())
    assert mixing.mix(empty_docs(spark)).collect() == []
    out = mixing.apply_mix(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns
    copies = Counter()
    for r in mixing.mix(edge_docs(spark)).collect():
        copies[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len(words(r.text))) for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.apply_mix(empty_docs(spark)).collect() == []
