"""Periodic runs of words, found on harmonic grids, and texts with their repeats collapsed.

A run is a stretch of words with a period that no neighbouring word extends. A stretch
of at least two periods p holds two neighbouring points of the grid 0, p, 2p, ...; so
for every p, and every pair jp and (j+1)p, one query says how far the words agree going
forward and one how far going backward, and both together are the stretch. The grids of
all periods have n ln n points. Queries are answered by the suffix array of the text's
word numbers, that of the reversed text, and range minima over their common prefixes.
Points whose words, or whose nearest words on both sides, differ cannot lie in a
run that is long enough, and are not queried; a text without other points needs no array.
A stretch that is found with several periods has the smallest of them as its period.

Each text is one row's work inside a task: nothing is shuffled. Arrays take about
``60 n`` bytes and ``4 n`` more each time the longest repeat doubles; grid points are made a few hundred thousand at a
time. Null and empty texts have no words, no runs, and the digest of the empty text.
A null id counts as the empty text where its checksum is needed. Repeated rows give
repeated results; of runs that are equally long the first counts, then the one with the smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import utf8

LEAST_LENGTH = 12
POINTS_AT_ONCE = 1 << 18
BLOCK = 16


class Runs(NamedTuple):
    """Runs by start and then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Minima:
    """Range minima: a table of doubling spans over blocks, and the rest of a range read from its two border blocks."""

    def __init__(self, values: np.ndarray):
        top = np.iinfo(np.int32).max
        blocks = max(1, -(-len(values) // BLOCK))
        self.grid = np.full((blocks, BLOCK), top, dtype=np.int32)
        self.grid.reshape(-1)[: len(values)] = values
        self.before = np.minimum.accumulate(self.grid, axis=1).reshape(-1)  # from the block's beginning
        self.after = np.minimum.accumulate(self.grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # to its end
        self.spans = [self.grid.min(axis=1)]
        while 2 << (len(self.spans) - 1) <= blocks:
            last, half = self.spans[-1], 1 << (len(self.spans) - 1)
            self.spans.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value at places a to b, both inside; a <= b."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.after[a], self.before[b])
        one = np.flatnonzero(first == last)
        if len(one):
            at = np.arange(BLOCK)
            inside = (at >= (a[one] % BLOCK)[:, None]) & (at <= (b[one] % BLOCK)[:, None])
            out[one] = np.where(inside, self.grid[first[one]], np.iinfo(np.int32).max).min(axis=1)
        many = np.flatnonzero(last - first > 1)
        if len(many):
            low, high = first[many] + 1, last[many]
            level = np.frexp(high - low)[1] - 1
            for k in np.unique(level):
                own = np.flatnonzero(level == k)
                span = self.spans[k]
                out[many[own]] = np.minimum(out[many[own]], np.minimum(span[low[own]], span[high[own] - (1 << k)]))
        return out


class Common:
    """How many words two suffixes have in common: suffix array, common prefixes of its neighbours, range minima."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]  # of the first 1, 2, 4, ... words
        span = 1
        while ranks[-1].max(initial=-1) < n - 1:
            second = np.zeros(n, dtype=np.int64)
            second[: max(0, n - span)] = ranks[-1][span:] + 1
            ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + second, return_inverse=True)[1].astype(np.int32))
            span *= 2
        self.rank = ranks[-1]
        order = np.empty(n, dtype=np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(max(0, n - 1), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):  # neighbours' common prefix, by its binary digits
            size, rank = 1 << k, ranks.pop()
            inside = np.flatnonzero(np.maximum(a, b) + size <= n)
            same = inside[rank[a[inside]] == rank[b[inside]]]
            shared[same] += size
            a[same] += size
            b[same] += size
        self.minima = Minima(shared)

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i < j, each below n."""
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b), np.maximum(a, b) - 1).astype(np.int64)


def _grid_points(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places jp and periods p whose words agree with those at (j+1)p and, on one side at least, around them."""
    n, out = len(words), []
    each = (n - 1) // np.arange(1, n // 2 + 1)  # pairs of neighbouring points per period
    ends = np.cumsum(each)
    # A run agrees with itself, a period on, at max(least, 2p) - p places in a row or more.
    need = np.maximum(least, 2 * np.arange(1, n // 2 + 1)) - np.arange(1, n // 2 + 1)
    cut = 0
    while cut < len(each):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + POINTS_AT_ONCE, side="right")))
        size = each[cut:stop]
        period = np.repeat(np.arange(cut + 1, stop + 1), size)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(size) - size, size)) * period
        same = np.flatnonzero(words[place] == words[place + period])
        place, period = place[same], period[same]
        side = need[period - 1] // 2  # so many more on one of the sides
        ahead, back = np.ones(len(place), dtype=bool), np.ones(len(place), dtype=bool)
        for k in range(1, 4):
            wanted = side >= k
            to = place + period + k
            ahead &= ~wanted | ((to < n) & (words[np.minimum(place + k, n - 1)] == words[np.minimum(to, n - 1)]))
            back &= ~wanted | ((place >= k) & (words[np.maximum(place - k, 0)] == words[np.maximum(place + period - k, 0)]))
        keep = ahead | back
        out.append((place[keep], period[keep]))
        cut = stop
    return np.concatenate([x[0] for x in out] or [np.empty(0, np.int64)]), np.concatenate([x[1] for x in out] or [np.empty(0, np.int64)])


def find_runs(words: np.ndarray, least: int = LEAST_LENGTH) -> Runs:
    """All runs of ``max(least, 2 * period)`` words or more in a text given by its words' numbers."""
    n = len(words)
    none = np.empty(0, dtype=np.int64)
    place, period = _grid_points(words, least) if n >= max(2, least) else (none, none)
    if not len(place):
        return Runs(none, none, none)
    ahead = Common(words).prefix(place, place + period)
    back = np.zeros(len(place), dtype=np.int64)
    inner = np.flatnonzero(place > 0)
    if len(inner):  # the words before place i end the reversed text's suffix n - i
        back[inner] = Common(words[::-1]).prefix(n - place[inner] - period[inner], n - place[inner])
    start, length = place - back, period + ahead + back
    kept = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start[kept], length[kept], period[kept]]), axis=1)
    if found.shape[1]:  # sorted by start, length and period: the first period of a stretch is its smallest
        fresh = np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)])
        found = found[:, fresh]
        found = found[:, np.lexsort((found[2], found[0]))]
    return Runs(*found)


def repeats(runs: Runs, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    return np.cumsum(edge[:n]) > 0


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def planted(n: int, checksum: int) -> np.ndarray:
    """Which word stands at each of n places: one text in ten, by its id's checksum, repeats a stretch up to its end."""
    at = np.arange(n)
    if checksum % 10 == 0 and n:
        seed = checksum // 10
        first = seed % n
        period = 1 + (n - first) // (3 + seed % 8)
        at[first:] = first + np.arange(n - first) % period
    return at


RESULT = [
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
]


def described(text: bytes, checksum: int | None = None, least: int = LEAST_LENGTH) -> tuple:
    """The columns of ``RESULT`` for one text, with a planted repeat if a checksum is given."""
    words = text.split()  # bytes split at 20 and 09 to 0D
    if checksum is not None and checksum % 10 == 0:
        words = [words[k] for k in planted(len(words), checksum).tolist()]
    runs = find_runs(np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words)), least)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(*(x.tolist() for x in runs)))
    best: tuple = (None,) * 4
    if len(runs.start):
        k = int(np.lexsort((runs.period, runs.start, -runs.length))[0])
        s, n, p = (int(x[k]) for x in runs)
        best = (s, n, p, 1000 * n // p)
        words = [w for w, gone in zip(words, repeats(runs, len(words)).tolist()) if not gone]
    return (len(runs.start), *best, sha256(lines.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, plant: bool = False) -> DataFrame:
    """``(id_col, *RESULT)`` per row; ``plant`` first gives one text in ten a repeat, by the checksum of its id."""
    kind = docs.schema[id_col].dataType.simpleString()
    checksum = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) if plant else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(value.as_py(), h, least) for h, value in zip(batch.column(1).to_pylist(), batch.column(2))]
            columns = list(zip(*rows)) or [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, RESULT)]], names=[id_col, *[n for n, _ in RESULT]])

    fields = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in RESULT)
    return docs.select(id_col, checksum.alias("checksum"), utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, {fields}")


def op13_runs(documents: DataFrame) -> DataFrame:
    return periodic_runs(documents, plant=True)
