"""Periodic runs of words: stretches that repeat with a period, found as maximal pairs of equal substrings.

Two equal stretches of length l that start q apart and can be lengthened neither to the left nor to the right are a
maximal pair. Where l >= 3 q they overlap in a stretch of q + l words with period q, four periods at least, and being
maximal it is a run as it stands: nothing is left to extend. So runs are the maximal pairs whose distance fits, except
that a multiple of the period gives the same stretch again; of one stretch the least distance counts.

Maximal pairs come from the LCP intervals of the suffix array, bottom up. An interval has its positions as a sorted
list, and as one sorted list for each word to their left. When a child is merged into its parent, the smaller list is
walked: the partners within distance l / 3 less those with the same word to the left are counted by binary search in
the two lists, and read out only where some are left. The smaller side is always the one that moves.

Suffixes are sorted for many texts at once by prefix doubling in numpy; equal words get equal numbers by themselves,
not by hashes. Only suffixes that share four words with another one of their text are sorted further, and only
intervals with positions near enough to each other are walked.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, quoted, tune, utf8

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Equal words of a maximal pair: a run of LEAST_WORDS with period one has so many.
LEAST_EQUAL = LEAST_WORDS - 1
#: Words of the texts that are worked on at a time, unless one text has more.
CHUNK_WORDS = 1 << 18

Run = tuple[int, int, int]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the place where its text has it first, and the text's first place; after each text comes a number of its own."""
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in texts], out=firsts[1:])
    out = np.empty(firsts[-1], np.int64)
    for words, at in zip(texts, firsts.tolist()):
        seen: dict[bytes, int] = {}
        end = at + len(words)
        out[at:end] = np.fromiter(map(seen.setdefault, words, count(at)), np.int64, len(words))
        out[end] = end
    return out, firsts


def ranked(numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks of all suffixes by their first 1, 2, 4, ... words, the suffixes that share four words with another, in order).

    A rank is the place in the order where the suffixes with the same words begin. Doubling sorts only those that
    are not alone yet, each by the rank of its own first words and of the next ones.
    """
    n = len(numbers)
    sizes = np.bincount(numbers, minlength=n)
    ranks = [(np.cumsum(sizes) - sizes)[numbers]]
    active = np.flatnonzero(sizes[numbers] > 1)
    kept, width = active, 1
    while len(active):
        rank = ranks[-1]
        following = np.where(active + width < n, rank[np.minimum(active + width, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + following
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        place = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        part = np.maximum.accumulate(np.where(new, place, 0))
        grown = rank.copy()
        grown[active] = old + part - group
        ranks.append(grown)
        alone = new & np.r_[new[1:], True]
        active = active[~alone]
        width *= 2
        if width == 4:
            kept = active
    if width < 4:
        kept = active
    return ranks, kept[np.argsort(ranks[-1][kept], kind="stable")]


def common_prefixes(numbers: np.ndarray, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Equal words of each suffix in order and the one before it (0 for the first), from the ranks, widest first."""
    a, b = order[:-1].copy(), order[1:].copy()
    last = len(numbers) - 1
    for k in range(len(ranks) - 1, -1, -1):
        # a suffix that is alone has a rank of its own, and texts end in numbers of their own
        same = (ranks[k][np.minimum(a, last)] == ranks[k][np.minimum(b, last)]) & (a <= last) & (b <= last)
        a += same << k
        b += same << k
    return np.r_[0, b - order[1:]]


def near_enough(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Whether a suffix is in a stretch of the order, joined by LEAST_EQUAL words, that has two places no farther apart than a third of the most it shares."""
    part = np.cumsum(lcp < LEAST_EQUAL)
    by_place = np.lexsort((order, part))
    gap = np.where(np.diff(part[by_place]) == 0, np.diff(order[by_place]), np.iinfo(np.int64).max)
    most, least = np.zeros(part[-1] + 1, np.int64), np.full(part[-1] + 1, np.iinfo(np.int64).max)
    np.maximum.at(most, part, lcp)
    np.minimum.at(least, part[by_place][1:], gap)
    return (least <= most // (LEAST_PERIODS - 1))[part]


class Interval:
    """An LCP interval: the places of its suffixes, sorted, and by the word to their left."""

    __slots__ = ("shared", "places", "by_left")

    def __init__(self, shared: int, place: int, left: int) -> None:
        self.shared, self.places, self.by_left = shared, [place], {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.places, place)
        own = self.by_left.get(left)
        if own is None:
            self.by_left[left] = [place]
        else:
            insort(own, place)


def partners(into: Interval, place: int, left: int, reach: int, left_of: dict[int, int]) -> Iterator[int]:
    """The places of the interval no farther than reach with another word to the left.

    Places of one interval that are so near lie one period apart, and only the first of them can have another word to
    its left than the rest, so that those wanted come first or are all of them.
    """
    places, own = into.places, into.by_left.get(left, ())
    lo, hi = bisect_left(places, place - reach), bisect_left(places, place + reach + 1)
    wanted = hi - lo
    if wanted and own:
        wanted -= bisect_left(own, place + reach + 1) - bisect_left(own, place - reach)
    while wanted:
        other = places[lo]
        if left_of[other] != left:
            yield other
            wanted -= 1
        lo += 1


def maximal_pairs(order: list[int], lcp: list[int], lefts: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, place after it, equal words) of all maximal pairs of LEAST_EQUAL equal words and more, and a distance of a third of them at most.

    order: suffixes in order; lcp: equal words with the one before; lefts: the word to the left of each, or one of its
    own where there is none.
    """
    stack: list[Interval] = []
    left_of = dict(zip(order, lefts))

    def merged(into: Interval, child: Interval, shared: int) -> Iterator[tuple[int, int, int]]:
        """Pairs between the two, then the smaller is added to the larger; into holds both afterwards."""
        small, large = (child, into) if len(child.places) <= len(into.places) else (into, child)
        for left, places in small.by_left.items():
            for place in places:
                for other in partners(large, place, left, shared // (LEAST_PERIODS - 1), left_of):
                    yield min(place, other), max(place, other), shared
        for left, places in small.by_left.items():
            for place in places:
                large.add(place, left)
        into.places, into.by_left = large.places, large.by_left

    for i, place in enumerate(order):
        shared = lcp[i]
        if shared < LEAST_EQUAL:
            while len(stack) > 1:
                child = stack.pop()
                yield from merged(stack[-1], child, stack[-1].shared)
            stack.clear()
            stack.append(Interval(0, place, lefts[i]))
            continue
        # intervals that share more than this suffix does with the one before it are whole
        while len(stack) > 1 and stack[-2].shared >= shared and stack[-1].shared > shared:
            child = stack.pop()
            yield from merged(stack[-1], child, stack[-1].shared)
        stack[-1].shared = shared
        stack.append(Interval(2**62, place, lefts[i]))
    while len(stack) > 1:
        child = stack.pop()
        yield from merged(stack[-1], child, stack[-1].shared)


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs (start, length, period) of each text's words, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    numbers, firsts = numbered(texts)
    if not len(numbers):
        return out
    ranks, order = ranked(numbers)
    if not len(order):
        return out
    lcp = common_prefixes(numbers, ranks, order)
    del ranks
    used = near_enough(order, lcp)
    order, lcp = order[used], lcp[used]
    text = np.searchsorted(firsts, order, "right") - 1
    lefts = np.where(order > firsts[text], numbers[order - 1], -1 - order)
    found: dict[tuple[int, int], int] = {}
    for a, b, shared in maximal_pairs(order.tolist(), lcp.tolist(), lefts.tolist()):
        stretch = (a, b + shared)
        found[stretch] = min(b - a, found.get(stretch, b - a))
    for (start, end), period in found.items():
        k = int(np.searchsorted(firsts, start, "right")) - 1
        out[k].append((start - int(firsts[k]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.cumsum(change[:-1]) == 0
        words = [w for w, k in zip(words, kept.tolist()) if k]
    return b" ".join(words)


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
ARROW_RUNS = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))


def period_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length and period, in words) and collapsed (UTF-8 bytes), each in place of a column of that name.

    Words are what white space of ASCII parts, compared by their bytes. Null and empty texts have no words. A run is a
    stretch with smallest period q of LEAST_WORDS and LEAST_PERIODS * q words at least that neither neighbour extends;
    runs may overlap. Rows are worked on as they come, with no shuffle; a task holds the suffixes of CHUNK_WORDS words
    or of one longer text.
    """
    tune(docs.sparkSession)
    name = next(f"raw{'_' * k}" for k in range(len(docs.columns) + 1) if f"raw{'_' * k}" not in docs.columns)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.BinaryType())]

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            words = [(x or b"").split() for x in batch.column(name).to_pylist()]
            runs: list[list[Run]] = []
            lo = total = 0
            for i, w in enumerate(words):
                if i > lo and total + len(w) > CHUNK_WORDS:
                    runs += runs_of(words[lo:i])
                    lo, total = i, 0
                total += len(w) + 1
            runs += runs_of(words[lo:])
            structs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            return [pa.array([len(w) for w in words], pa.int64()), pa.array(structs, ARROW_RUNS), pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary())]

        return work

    held = docs.withColumn(name, utf8(quoted(text_col)))
    return add_columns(held, [name], fields, make).drop(name)


