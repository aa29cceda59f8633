"""Periodic runs of words by Stoye and Gusfield's suffix tree.

A text is a string over its words. The inner nodes of its suffix tree are the intervals of its suffix array (built by
prefix doubling, in which only suffixes that are not yet told apart are sorted again) whose members share a prefix. For
each node of depth D the leaves outside its largest child, the smaller half, are listed, and each leaf i is asked
whether i + D or i - D is a leaf of the node too; if the words behind the two differ, that is a branching tandem repeat
of period D. So O(n log n) questions find one for every run, its last. Rotating it to the left as long as words agree
gives the whole run, and repeats that end up as the same stretch merge into the one of least period.

All leaves at the ends of a run's periods lie in its node, so nodes with fewer leaves than a run has periods are
passed over. Texts of a task are worked off by numpy in blocks of about BLOCK bytes, all texts of a block at once;
suffixes of different texts never meet. A text longer than that is a block of its own, and takes about 300 bytes of
memory a word.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text. A text of one word
repeated is one run. Repeated rows each give a row. Ids may be null. An empty table gives no rows. Words are compared
as bytes. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_POWER = 6, 4
BLOCK = 2_000_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _group_starts(fresh: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The index at which each one's group begins."""
    return np.maximum.accumulate(np.where(fresh, index, 0))


class SuffixTree:
    """The suffix trees of several strings of numbers: `word` holds one string behind the other, `end[i]` is where
    the string of position i ends. order: suffixes sorted, place: where each stands, levels[k]: equal numbers for
    positions that begin the same 2^k words of one string, common[i]: words that order[i - 1] and order[i] share."""

    def __init__(self, word: np.ndarray, end: np.ndarray) -> None:
        self.word, self.end = word, end
        n = len(word)
        key = end.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
        order = np.argsort(key, kind="stable")
        todo, sub, key, rank, step = np.arange(n), order, key[order], np.empty(n, np.int64), 0
        self.levels: list[np.ndarray] = []
        while len(todo):
            fresh = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[sub] = _group_starts(fresh, todo)
            self.levels.append(rank)
            todo = todo[~(fresh & np.r_[fresh[1:], True])]
            step = 2 * step or 1
            sub = order[todo]
            behind = np.where(sub + step < end[sub], rank[np.minimum(sub + step, n - 1)] + 1, 0)
            key = rank[sub] * (n + 1) + behind
            by = np.argsort(key, kind="stable")
            sub, key = sub[by], key[by]
            order[todo] = sub
        self.order, self.place = order, rank
        self.common = self._common()

    def _common(self) -> np.ndarray:
        common = np.full(len(self.word) + 1, -1, np.int64)
        if len(self.word) < 2:
            return common
        left, right = self.order[:-1], self.order[1:]
        near = np.flatnonzero(self.levels[0][left] == self.levels[0][right])
        left, right = left[near], right[near]
        shared = np.zeros(len(near), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            x, y = left + shared, right + shared
            inside = (x < self.end[left]) & (y < self.end[right])
            inside[inside] = self.levels[k][x[inside]] == self.levels[k][y[inside]]
            shared += inside.astype(np.int64) << k
        common[1:-1] = 0
        common[near + 1] = shared
        return common

    def _nearest_smaller(self, at: np.ndarray, side: int) -> np.ndarray:
        """For the places at: the next one to a side that shares less, by jumping over those that share as much."""
        jump = np.arange(len(self.common)) + side
        todo = at[self.common[jump[at]] >= self.common[at]]
        while len(todo):
            jump[todo] = jump[jump[todo]]
            todo = todo[self.common[jump[todo]] >= self.common[todo]]
        return jump[at]

    def smaller_halves(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, depth, low, high): for every inner node with at least so many leaves, which are order[low:high],
        each leaf outside the largest child."""
        at = np.flatnonzero(self.common > 0)
        low, high = self._nearest_smaller(at, -1), self._nearest_smaller(at, 1)
        big = high - low >= least
        at, low, high = at[big], low[big], high[big]
        if not len(at):
            return at, at, at, at
        by = np.argsort(low * np.int64(len(self.common) + 1) + high, kind="stable")  # children of a node one after another
        at, low, high = at[by], low[by], high[by]
        first = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        last = np.r_[first[1:], True]
        node = np.cumsum(first) - 1
        # a child ends at every place of its node, and one more at the node's end
        begin = np.r_[np.where(first, low, np.r_[0, at[:-1]]), at[last]]
        stop, owner = np.r_[at, high[last]], np.r_[node, node[last]]
        size = stop - begin
        by_size = np.lexsort((size, owner))
        keep = np.ones(len(size), bool)
        keep[by_size[np.r_[owner[by_size][1:] != owner[by_size][:-1], True]]] = False
        begin, size, owner = begin[keep], size[keep], owner[keep]
        total = np.cumsum(size)
        leaf = np.arange(total[-1]) + np.repeat(begin - (total - size), size)
        of = np.repeat(np.flatnonzero(first)[owner], size)
        return self.order[leaf], self.common[at[of]], low[of], high[of]

    def branching_repeats(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of the tandem repeats that the next word doesn't go on with, in nodes of so many leaves."""
        leaf, depth, low, high = self.smaller_halves(least)
        starts, periods, n = [], [], len(self.word)
        for other in (leaf + depth, leaf - depth):
            there = (other >= 0) & (other < n)
            there[there] = (self.place[other[there]] >= low[there]) & (self.place[other[there]] < high[there])
            start, period = np.minimum(leaf, other)[there], depth[there]
            behind = start + 2 * period
            ends = behind == self.end[start]
            ends[~ends] = self.word[behind[~ends]] != self.word[(start + period)[~ends]]
            starts.append(start[ends])
            periods.append(period[ends])
        return np.concatenate(starts), np.concatenate(periods)

    def runs(self, least_length: int, least_power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all maximal runs of so many words and periods (at least two), by start, then period."""
        start, period = self.branching_repeats(least_power)
        stop, rotated = start + 2 * period, np.zeros(len(start), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            x = start - rotated - (1 << k)
            inside = x >= 0
            inside[inside] = self.levels[k][x[inside]] == self.levels[k][(x + period)[inside]]
            rotated += inside.astype(np.int64) << k
        start = start - rotated
        long = (stop - start >= least_length) & (stop - start >= least_power * period)
        start, stop, period = start[long], stop[long], period[long]
        by = np.lexsort((period, stop, start))
        start, stop, period = start[by], stop[by], period[by]
        merged = np.ones(len(start), bool)
        merged[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        start, stop, period = start[merged], stop[merged], period[merged]
        by = np.lexsort((period, start))
        return start[by], (stop - start)[by], period[by]


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of about so many bytes of text together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _collapsed(batch: pa.RecordBatch, least_length: int, least_power: int) -> pa.RecordBatch:
    text = pc.ascii_trim_whitespace(pc.fill_null(batch.column(1), ""))
    split = pc.ascii_split_whitespace(text)
    offsets = split.offsets.to_numpy().astype(np.int64)
    blank = pc.equal(text, "").to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    if blank.any():  # splitting an empty text gives one empty word
        word = word[np.repeat(~blank, np.diff(offsets))]
        offsets = np.r_[0, np.cumsum(np.where(blank, 0, np.diff(offsets)))]
    size = np.diff(offsets)
    tree = SuffixTree(word, np.repeat(offsets[1:], size))
    start, length, period = tree.runs(least_length, least_power)
    # a word goes if it stands in a run behind the run's first period
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    upto = np.r_[0, np.cumsum(kept)][offsets]
    values = coded.dictionary.take(pa.array(word[kept])) if len(word) else pa.array([], text.type)
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)
    owner = np.searchsorted(offsets, start, "right") - 1
    number = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    per_text = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))]
    found = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), number)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), found, pc.binary_join(lists, " ")], names=["id", "n_words", "runs", "collapsed"])


def _find(batches: Iterator[pa.RecordBatch], least_length: int, least_power: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch, most):
            yield _collapsed(block, least_length, least_power)


def periodic_runs(docs: DataFrame, key: str = "doc_id", least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER, block: int = BLOCK) -> DataFrame:
    """key, n_words, runs (all maximal runs of at least so many words and periods, by start, then period; counted in
    words from 0) and collapsed (the text's words without those in a run behind its first period, by single spaces)."""
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_find, least_length=least_length, least_power=least_power, most=block), f"id {kind}, n_words long, runs {RUNS}, collapsed string"
    )
    return found.withColumnRenamed("id", key)
