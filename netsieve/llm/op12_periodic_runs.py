"""Periodic runs of words in whole texts, by maximal pairs of an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and at least
max(MIN_WORDS, MIN_POWER * q) words that no neighbouring word extends.  Its
first word and the word q later begin equal stretches of length - q words that
differ in the word before and the word after: a maximal pair at distance q.
The other way round, a maximal pair of length l at distance q with
l >= max(MIN_WORDS - q, (MIN_POWER - 1) * q) spans exactly one run, so pairs
are runs as they come and nothing is extended.

1. Words become numbers by their bytes.  The suffixes of all texts of a slice
   are sorted together by prefix doubling (numpy); a suffix leaves the sort
   once it is unique, and texts never compare equal with each other.
2. Only suffixes that can start a pair stay: the next suffix with the same
   first words must lie within a third of the longest match.
3. The LCP intervals of those are merged bottom-up.  An interval keeps its
   positions in one sorted list per word on their left.  Joining two intervals
   of match length l looks up, for each position of the smaller one, the
   positions of the larger within l / (MIN_POWER - 1) under another left word:
   by position when the distance is short, else by bisection of each class.
4. Of the pairs that span the same words the smallest distance is the period.

One text is worked on in one task: about 8 bytes a word and doubling round.

Defined cases: NULL and empty texts have no words and no runs; a NULL id
changes nothing; NULL or repeated ids keep their rows; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.storage import map_arrow

MIN_WORDS, MIN_POWER = 6, 4
#: Shortest match of a pair that can be a run: distance 1 needs MIN_WORDS - 1 words.
SHORTEST = MIN_WORDS - 1

RUN = "start long, length long, period long"


def suffix_order(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(positions sorted by the words that follow, ties by round): prefix doubling over the texts of a slice.

    Each round is (words compared, positions still tied, their common rank).
    """
    n = len(codes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    key = text * (int(codes.max()) + 1 if n else 1) + codes
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    rounds, words = [], 1
    tied = ~(head & np.append(head[1:], True))
    slot = np.flatnonzero(tied)        # slots of the order whose suffixes are not yet unique
    while len(slot):
        at = order[slot]
        rounds.append((words, at.astype(np.int32), rank[at].astype(np.int32)))
        ahead = at + words
        inside = ahead < end[at]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        group = rank[at]
        by = np.lexsort((second, group))
        at, group, second = at[by], group[by], second[by]
        order[slot] = at               # groups keep their slots
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, slot, 0))
        slot = slot[~(new & np.append(new[1:], True))]
        words *= 2
    return order, rounds


def common_words(n: int, rounds, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that follow both positions alike."""
    found = np.zeros(len(a), np.int64)
    for words, at, rank in reversed(rounds):
        level = np.full(n + 1, -1, np.int32)
        level[at] = rank
        x, y = level[np.minimum(a + found, n)], level[np.minimum(b + found, n)]
        found += np.where((x >= 0) & (x == y), words, 0)
    return found


def _leaves(order: np.ndarray, rounds, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, match with the one before) of the suffixes that can start a pair."""
    none = np.empty(0, np.int64)
    tied = [r for r in rounds if r[0] * 2 >= SHORTEST]
    if not tied:
        return none, none
    among = np.zeros(n, bool)          # ties of at least half the shortest match; longer ones are among them
    among[tied[0][1]] = True
    at = order[among[order]]
    match = np.zeros(len(at) + 1, np.int64)
    match[1:-1] = common_words(n, rounds, at[:-1], at[1:])
    longest = np.maximum(match[:-1], match[1:])
    group = np.cumsum(match[:-1] < SHORTEST)
    by = np.lexsort((at, group))
    far = np.iinfo(np.int64).max
    gap = np.where(group[by][1:] == group[by][:-1], at[by][1:] - at[by][:-1], far)
    near = np.empty(len(at), np.int64)
    near[by] = np.minimum(np.append(far, gap), np.append(gap, far))
    keep = np.flatnonzero(near <= longest // (MIN_POWER - 1))
    if not len(keep):
        return none, none
    # Each stretch of matches ends at a kept suffix: its least value is the match with the kept one before.
    between = np.minimum.reduceat(match[:keep[-1] + 1], np.append(0, keep[:-1] + 1))
    return at[keep], between


class _Interval:
    """Positions of one LCP interval, in one sorted list per left word."""

    __slots__ = ("classes", "members")

    def __init__(self, position: int, left: int):
        self.members, self.classes = {position}, {left: [position]}

    def near(self, x: int, left_of_x: int, reach: int, left: list[int]):
        """Positions within ``reach`` of x whose left word differs from x's."""
        if 2 * reach <= 4 * len(self.classes):
            members = self.members
            for y in range(x - reach, x + reach + 1):
                if y in members and left[y] != left_of_x:
                    yield y
            return
        for c, some in self.classes.items():
            if c != left_of_x:
                yield from some[bisect_left(some, x - reach):bisect_right(some, x + reach)]

    def absorb(self, other: _Interval) -> None:
        self.members |= other.members
        for c, some in other.classes.items():
            mine = self.classes.get(c)
            if mine is None:
                self.classes[c] = some
            elif 8 * len(some) < len(mine):
                for x in some:
                    insort(mine, x)
            else:
                mine.extend(some)
                mine.sort()


def maximal_pairs(positions: list[int], match: list[int], left: list[int], emit: Callable[[int, int, int], None]) -> None:
    """Call ``emit(position, distance, length)`` for the maximal pairs that are runs, intervals bottom-up."""
    def joined(a: _Interval, b: _Interval, length: int) -> _Interval:
        if len(a.members) < len(b.members):
            a, b = b, a
        reach = length // (MIN_POWER - 1)
        for c, some in b.classes.items():
            for x in some:
                for y in a.near(x, c, reach, left):
                    i, q = (x, y - x) if x < y else (y, x - y)
                    if length >= MIN_WORDS - q:
                        emit(i, q, length)
        a.absorb(b)
        return a

    open_intervals: list[tuple[int, _Interval]] = []   # (match with what follows, interval), matches ascending
    last = None
    for x, l in zip(positions, match):
        if last is not None:
            if l < SHORTEST:
                while open_intervals:
                    length, before = open_intervals.pop()
                    last = joined(before, last, length)
            else:
                while open_intervals and open_intervals[-1][0] >= l:
                    length, before = open_intervals.pop()
                    last = joined(before, last, length)
                open_intervals.append((l, last))
        last = _Interval(x, left[x])
    while open_intervals:
        length, before = open_intervals.pop()
        last = joined(before, last, length)


def runs_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of the texts of a slice, by start, then period; starts count from the slice's first word."""
    n = len(codes)
    order, rounds = suffix_order(codes, first)
    at, match = _leaves(order, rounds, n)
    period: dict[tuple[int, int], int] = {}

    def emit(i: int, q: int, length: int) -> None:
        span = (i, length + q)
        if period.get(span, q) >= q:
            period[span] = q

    if len(at):
        left = np.append(-1, codes[:-1])
        left[first[:-1][first[:-1] < n]] = -1
        maximal_pairs(at.tolist(), match.tolist(), left.tolist(), emit)
    found = np.array([(s, l, q) for (s, l), q in period.items()], np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _joined_words(t: T.Texts, w: T.Words, source: np.ndarray, first: np.ndarray) -> pa.Array:
    """The given words of each text joined by one space; ``first`` of each text in ``source``."""
    size = (w.ends - w.starts)[source] + 1
    total = int(size.sum())
    before = np.cumsum(size) - size
    take = np.repeat(w.starts[source] - before, size) + np.arange(total)
    data = t.buf[np.minimum(take, max(len(t.buf) - 1, 0))] if total else np.empty(0, np.uint8)
    data[before + size - 1] = 0x20
    upto = np.append(before, total)[first]
    last = upto[1:][np.diff(upto) > 0] - 1          # the space after a text's last word goes
    keep = np.ones(total, bool)
    keep[last] = False
    offsets = upto - np.append(0, np.cumsum(np.diff(upto) > 0))
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(data[keep])))


def looped(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """Which word stands at each place when a tenth of the texts are made to repeat themselves.

    With h the crc32 of the id's decimal text, texts with h % 10 = 0 repeat
    from a fixed place on with a fixed period, both functions of h.
    """
    source = np.arange(first[-1])
    hashes = T.crc32_of_ids(np.array([0 if i is None else i for i in ids], np.int64))
    for k, (i, h) in enumerate(zip(ids, hashes.tolist())):
        lo, n = int(first[k]), int(first[k + 1] - first[k])
        if i is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[lo + a:lo + n] = lo + a + np.arange(n - a) % p
    return source


def _rows(loop: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, t in T.slices(batch.column(1)):
                w, texts = T.words(t), len(t.offsets) - 1
                part = ids.slice(lo, texts)
                codes, _ = T.span_codes(t.buf, w.starts, w.ends)
                source = looped(part.to_pylist(), w.first) if loop else np.arange(len(codes))
                found = runs_of(codes[source], w.first)
                extra = np.zeros(len(codes) + 1, np.int64)
                np.add.at(extra, found[:, 0] + found[:, 2], 1)
                np.add.at(extra, found[:, 0] + found[:, 1], -1)
                kept = np.cumsum(extra[:-1]) == 0
                kept_before = np.append(0, np.cumsum(kept))
                text = np.searchsorted(w.first, found[:, 0], "right") - 1
                struct = pa.StructArray.from_arrays(
                    [pa.array(found[:, 0] - w.first[text]), pa.array(found[:, 1]), pa.array(found[:, 2])],
                    names=["start", "length", "period"])
                bounds = np.searchsorted(text, np.arange(texts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), struct),
                     _joined_words(t, w, source[kept], kept_before[w.first]).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, loop: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text.

    Args:
        docs: rows with ``doc_id`` and ``text``.
        loop: first make a tenth of the texts repeat themselves (``looped``).

    ``runs`` holds (start, length, period) by start, then period.  ``collapsed``
    is the text with every run cut to its first period, words joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _rows(loop), f"doc_id long, n_words long, runs array<struct<{RUN.replace(' long', ': bigint')}>>, collapsed string")


def _better(a: Column, b: Column) -> Column:
    """The run of greatest length / period, compared exactly; ``a`` comes first in order and so wins ties."""
    return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)


def run_report(docs: DataFrame, loop: bool = True) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, loop)
    found = found.withColumn("best", F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), _better))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                     r["period"].cast("string")))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
