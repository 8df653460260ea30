"""Periodic runs of words: maximal stretches that repeat themselves, found by the runs theorem.

Each run's Lyndon roots are longest Lyndon words under one of two opposite orders of the words. The longest Lyndon word
at a place ends where the next smaller value of the inverse suffix array stands, and a root is extended to its run by
the longest common extensions of its two ends, to the right and, in the reversed text, to the left: minima of the LCP
array, by a sparse table.

Words of a run of three periods stand there three times and so do its pairs of neighbours, nearly; where a pair of
words is the only one of its kind in the text no run goes through. So texts are cut there first, which loses and
changes no run, and what is too short is left out. The rest of many texts is worked on together, in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of texts that are worked on together.
TOGETHER = 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_ranks(codes: np.ndarray, part: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank of each suffix of its part among all, later parts less than earlier ones, by prefix doubling.

    ``part`` numbers the parts from 0 in order and ``ends`` has each place's end of its part. A suffix that another one
    goes on from is the less. Only places whose rank is still shared are sorted again.
    """
    n = len(codes)
    key = (part[-1] - part).astype(np.int64) * (int(codes.max()) + 1) + codes if n else codes
    active, rank, k = np.arange(n), np.zeros(n, np.int64), 0
    while len(active):
        if k:
            ahead = active + k
            inside = ahead < ends[active]
            key = rank[active] * (n + 2) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        fresh = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        if k:
            old = rank[active]
            head = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), np.arange(len(key)), 0))
            rank[active] = old + start - head
        else:
            rank[active] = start
        shared = ~(fresh & np.append(fresh[1:], True))
        active, k = active[shared], max(1, 2 * k)
    return rank


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the length if there is none."""
    held = rank.tolist()
    n = len(held)
    held.append(-1)
    out = [n] * n
    for i in range(n - 1, -1, -1):
        x, j = held[i], i + 1
        while held[j] > x:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


class Extensions:
    """Longest common extensions of places of one part: the suffix ranks and the LCP array of neighbours."""

    def __init__(self, codes: np.ndarray, part: np.ndarray, ends: np.ndarray):
        self.ends, self.rank = ends, suffix_ranks(codes, part, ends)
        n = len(codes)
        suffix = np.empty(n, np.int64)
        suffix[self.rank] = np.arange(n)
        words, left, rank, before = codes.tolist(), (ends - np.arange(n)).tolist(), self.rank.tolist(), np.append(-1, suffix[:-1])[self.rank]
        before[before >= 0] = np.where(part[before[before >= 0]] == part[before >= 0], before[before >= 0], -1)
        lcp, h = [0] * n, 0
        for i, j in enumerate(before.tolist()):
            if j < 0:
                h = 0
                continue
            most = min(left[i], left[j])
            while h < most and words[i + h] == words[j + h]:
                h += 1
            lcp[rank[i]] = h
            h = max(0, h - 1)
        self.lcp = np.array(lcp, np.int64)

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, inside their parts. Places of different parts have none in common.

        A query needs one level of the sparse table, so levels are made and used one after another.
        """
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.where(a == b, self.ends[a] - a, 0)
        table, k = self.lcp, 0
        while True:
            here = np.flatnonzero((level == k) & (a != b))
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k)])
            if k >= level.max(initial=-1):
                return out
            table, k = np.minimum(table[: len(table) - (1 << k)], table[1 << k :]), k + 1


def runs_of(codes: np.ndarray, part: np.ndarray, ends: np.ndarray, starts: np.ndarray, min_length: int, min_periods: int) -> np.ndarray:
    """Distinct rows (start, length, period) of the runs inside parts, with ``min_length`` words and ``min_periods`` periods or more."""
    n = len(codes)
    if not n:
        return np.empty((0, 3), np.int64)
    right = Extensions(codes, part, ends)
    top = int(codes.max())
    found = []
    for rank in (right.rank, suffix_ranks(top - codes, part, ends)):
        i, j = np.arange(n), next_smaller(rank)
        # the first root in a run of three periods has two more behind it, so from its start on two periods lie inside
        i = np.flatnonzero((j + (j - i) <= ends) & (codes == codes[np.minimum(j, n - 1)]))
        found.append(np.stack([i, j[i]], axis=1))
    i, j = np.unique(np.concatenate(found), axis=0).T
    more = right.lengths(i, j)
    i, j, more = i[more >= j - i], j[more >= j - i], more[more >= j - i]
    if not len(i):
        return np.empty((0, 3), np.int64)
    left = Extensions(codes[::-1], part[-1] - part[::-1], n - starts[::-1])
    back = np.where(i > starts[i], left.lengths(np.minimum(n - i, n - 1), np.minimum(n - j, n - 1)), 0)
    runs = np.unique(np.stack([i - back, j + more - i + back, j - i], axis=1), axis=0)
    return runs[(runs[:, 1] >= min_length) & (runs[:, 1] >= min_periods * runs[:, 2])]


def runs_of_texts(texts: list[list[bytes]], min_length: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(t) for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    held = np.empty(sizes.sum(), object)
    held[:] = [w for t in texts for w in t]
    codes = pd.factorize(held)[0].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes))
    # pairs of neighbours that stand once in their text part it
    pairs = np.flatnonzero(text[1:] == text[:-1])
    _, kind, count = np.unique(_triples(text[pairs], codes[pairs], codes[pairs + 1]), return_inverse=True, return_counts=True)
    linked = np.zeros(len(codes), bool)
    linked[pairs + 1] = count[kind] > 1
    first = np.flatnonzero(~linked)
    long = np.diff(np.append(first, len(codes))) >= max(min_length, min_periods)
    part = np.cumsum(~linked) - 1
    kept = long[part]
    at, part = place[kept], np.cumsum(~linked[kept]) - 1
    begins = np.flatnonzero(~linked[kept])
    lasts = np.append(begins[1:], len(at))
    found = runs_of(codes[kept], part, lasts[part], begins[part], min_length, min_periods) if len(at) else np.empty((0, 3), np.int64)
    offset = np.cumsum(sizes) - sizes
    for start, length, period in found.tolist():
        own = text[at[start]]
        out[own].append((int(at[start] - offset[own]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _triples(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each triple, the same for equal ones only."""
    size = int(max(a.max(initial=0), b.max(initial=0))) + 1
    if (int(text.max(initial=0)) + 1) * size * size < 2**63:
        return (text * size + a) * size + b
    pair = np.unique(a * size + b, return_inverse=True)[1]
    return text * len(a) + pair


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def most_periodic(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period, the first of several, of these the one of least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def repeat_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """In one text of ten, by the CRC-32 of its id, the words from some place on repeat themselves. None without an id."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_length: int = 24, min_periods: int = 3, change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The columns of ``docs``, ``n_words``, ``runs``, ``best`` and ``collapsed``, for every whole text.

    Words are what white space (20, 09 to 0D) parts; ``change`` may turn an id and its words into others first. A run is
    a stretch of ``min_length`` words and ``min_periods`` periods or more, words of its smallest period apart equal, that
    no neighbour extends. ``runs`` has start (word number from 0), length and period, by start, then period; ``best``
    is the one of greatest length by period (ties: smallest start, then period), null if there is none; ``collapsed`` has
    the words that no run contains after its first period, joined by a space.

    Edge cases: null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows are read each;
    null ids are passed to ``change`` as None; an empty table gives an empty one; other columns are carried along, and
    columns named like the new ones are replaced. ``min_periods`` must be 3 or more and ``min_length`` 3 or more.
    """
    if min(min_periods, min_length) < 3:
        raise ValueError("runs of fewer than three periods or words are not looked for")
    new = ["n_words", "runs", "best", "collapsed"]
    kept = [c for c in docs.columns if c not in new]
    ids, place = kept.index(key), kept.index(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, many = 0, [], 0
            for k in range(batch.num_rows):
                own = (batch.column(place)[k].as_py() or "").encode().split()
                held.append(change(batch.column(ids)[k].as_py(), own) if change else own)
                many += len(own)
                if many >= TOGETHER or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, *told(held)], [*kept, *new])
                    begin, held, many = k + 1, [], 0

    def told(texts: list[list[bytes]]) -> list[pa.Array]:
        found = runs_of_texts(texts, min_length, min_periods)
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        named = lambda r: r and dict(zip(("start", "length", "period"), r))
        collapsed = [b" ".join(without_repeats(t, r)).decode() for t, r in zip(texts, found)]
        return [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[named(r) for r in runs] for runs in found], pa.list_(one)),
            pa.array([named(most_periodic(runs)) for runs in found], one),
            pa.array(collapsed, pa.string()),
        ]

    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    run = T._parse_datatype_string(RUN)
    schema = T.StructType([*slim.schema, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("best", run), T.StructField("collapsed", T.StringType())])
    return slim.mapInArrow(read, schema)
