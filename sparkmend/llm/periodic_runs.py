"""Periodic runs of words, found by uniting suffix classes.

A run is a stretch of words that repeats with a period.  The suffixes of a text
are sorted, and neighbours in that order are united by falling length of their
common prefix (LCP), as Kruskal's algorithm takes edges; a union-find forest
keeps the classes, an ordered set the positions of each.  When two classes
meet at LCP ``l``, positions that become neighbours at a distance ``d <= l``
start a square of period ``d``: the first of a run's positions always meets the
one a period later this way, and ``d`` is then the smallest period, as any
smaller one would lie between them.  So the run is read off at once: it
begins where the word before breaks the period, and has ``l + d`` words.

Several texts are handled in one array of word numbers; numbers are not shared
between texts, so that no common prefix crosses a border.  Suffixes whose first
words do not recur stay classes of one and are sorted out by a hash beforehand.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without

RESULT = ("n_words", "runs", "collapsed")
MIN_LENGTH, MIN_EXPONENT = 6, 4
CHUNK = 1 << 19  # words handled at once (a longer text is one chunk)
BLOCK = 1024  # positions of a block of an ordered set


class Positions:
    """Ordered set of positions, in blocks so that an insertion moves few."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        k = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads.insert(k + 1, block[BLOCK])

    def around(self, x: int) -> tuple[int, int]:
        """The members before and after ``x`` (-1 where there is none)."""
        k = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else -1
        after = block[at] if at < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else -1
        return before, after


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The smallest LCP at which two positions can start a run long enough."""
    return min(max(d * (min_exponent - 1), min_length - d) for d in range(1, max(min_length, 2)))


def recurring(words: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions whose next ``width`` words may occur elsewhere too
    (told by a 64-bit hash: too many at worst, never too few)."""
    n = len(words) - width + 1
    if n < 2:
        return np.zeros(len(words), bool)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + (words[k : k + n].astype(np.uint64) + np.uint64(1))
    hashes ^= hashes >> np.uint64(29)
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    mask = np.zeros(len(words), bool)
    if len(again):
        at = np.minimum(np.searchsorted(again, hashes), len(again) - 1)
        mask[:n] = again[at] == hashes
    return mask


def suffix_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of every suffix, by prefix doubling; only suffixes that still share
    their rank are sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    sizes = np.diff(first, append=n)
    todo = order[np.repeat(sizes, sizes) > 1]
    width = 1
    while len(todo):
        ahead = todo + width
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[todo]
        by = np.lexsort((key, old))
        todo, key, old = todo[by], key[by], old[by]
        index = np.arange(len(todo))
        new_old = np.diff(old, prepend=-1) != 0
        new = new_old | (np.diff(key, prepend=-1) != 0)
        group = np.maximum.accumulate(np.where(new_old, index, 0))
        part = np.maximum.accumulate(np.where(new, index, 0))
        rank[todo] = old + part - group
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(todo))
        todo = todo[np.repeat(sizes, sizes) > 1]
        width *= 2
    return rank


def neighbour_lcps(words: list[int], rank: list[int], order: list[int], active: np.ndarray) -> list[tuple[int, int, int]]:
    """(LCP, position, position before it in suffix order) of the positions
    ``active``, by rising position: an LCP shrinks by one word at most."""
    n, out, have, last = len(words), [], 0, -2
    for i in active.tolist():
        have = have - 1 if i == last + 1 and have else 0
        last = i
        if not rank[i]:
            have = 0
            continue
        j = order[rank[i] - 1]
        most = n - max(i, j)
        while have < most and words[i + have] == words[j + have]:
            have += 1
        out.append((have, i, j))
    return out


def unite(words: list[int], edges: list[tuple[int, int, int]], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from suffix neighbours (LCP, i, j)."""
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}
    runs = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def met(x: int, y: int, lcp: int) -> None:
        d = y - x
        if d * (min_exponent - 1) <= lcp and lcp + d >= min_length and (not x or words[x - 1] != words[y - 1]):
            runs.append((x, lcp + d, d))

    for lcp, i, j in sorted(edges, reverse=True):
        a, b = root(i), root(j)
        small, large = members.get(a) or Positions(a), members.get(b) or Positions(b)
        if small.size > large.size:
            a, b, small, large = b, a, large, small
        # neighbours across the two classes, before any of them moves
        inner = list(small)
        for k, x in enumerate(inner):
            before, after = large.around(x)
            if before >= 0 and (not k or inner[k - 1] < before):
                met(before, x, lcp)
            if after >= 0 and (k + 1 == len(inner) or inner[k + 1] > after):
                met(x, after, lcp)
        for x in inner:
            large.add(x)
        parent[a] = b
        members.pop(a, None)
        members[b] = large
    return runs


def chunk_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Runs of one array of word numbers, by start and period."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    least = least_lcp(min_length, min_exponent)
    active = recurring(words, least)
    if not active.any():
        return []
    rank = suffix_ranks(words)
    order = np.empty(len(words), np.int64)
    order[rank] = np.arange(len(words))
    words, rank, order = words.tolist(), rank.tolist(), order.tolist()
    edges = [e for e in neighbour_lcps(words, rank, order, np.flatnonzero(active)) if e[0] >= least]
    found = unite(words, edges, min_length, min_exponent)
    return sorted((start, length, period) for start, length, period in found)


def texts_runs(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as lists of words."""
    new, numbers, ends = count(), [], []
    for words in texts:
        own = defaultdict(new.__next__)  # not shared between texts
        numbers += map(own.__getitem__, words)
        ends.append(len(numbers))
    array = np.array(numbers, np.int64)
    # only texts with a recurring stretch are sorted
    hit = np.flatnonzero(recurring(array, least_lcp(min_length, min_exponent)))
    ends = np.array(ends)
    some = np.unique(np.searchsorted(ends, hit, side="right"))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(some):
        starts = ends[some] - [len(texts[k]) for k in some]
        joined = np.concatenate([array[a:b] for a, b in zip(starts, ends[some], strict=True)])
        inner = np.cumsum(ends[some] - starts)
        for start, length, period in chunk_runs(joined, min_length, min_exponent):
            k = int(np.searchsorted(inner, start, side="right"))
            out[some[k]].append((start - int(inner[k - 1] if k else 0), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a
    space."""
    if runs:
        keep = bytearray(b"\1") * len(words)
        for start, length, period in runs:
            keep[start + period : start + length] = bytes(length - period)
        words = [w for w, k in zip(words, keep, strict=True) if k]
    return b" ".join(words)


def find_runs(df: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``df`` with n_words, runs (start, length, period; by start, then period)
    and collapsed (the text without what its runs repeat).

    Words are what ASCII white space separates; a run has ``min_length`` words
    and ``min_exponent`` periods at least.  Null and empty texts have no words,
    no runs and an empty collapsed text; other columns, null ids and repeated
    rows are passed on; input columns named like a result column are dropped;
    an empty table gives an empty result.
    """
    least_lcp(min_length, min_exponent)
    df = without(df, *[c for c in RESULT if c != text_col])
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType(
        [*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    )
    place = df.columns.index(text_col)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def chunks(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
        held, size = [], 0
        for text in texts:
            held.append((text or b"").split())
            size += len(held[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(x.as_py() for x in batch.column(place).cast(pa.binary())):
                runs = texts_runs(texts, min_length, min_exponent)
                found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in runs]
                left = pa.array([collapse(*x) for x in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(found, kind), left],
                    [*batch.schema.names, "n_words", "runs", "collapsed"],
                )

    return df.mapInArrow(read, schema)
